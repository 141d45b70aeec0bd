"""Candidates are looked up where the windows left the rows."""

import __spark_entry__ as entry


def test_candidates_join_where_rows_lie(spark, sf):
    plan = entry.queries()["signature_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 4 and not any("<=>" in line or "coalesce" in line for line in joins)  # one for each odd part
