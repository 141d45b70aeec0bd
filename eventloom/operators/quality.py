"""Reading model answers as JSON, with a quarantine for those that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recovery import recover_json
from ..functions.text import ERROR_MARKERS, REQUIRED_ROUNDS


def recover(answers: DataFrame, kind: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``recovered`` JSON (and ``parsed`` for a schema), and the rows without any."""
    tried = answers.withColumn("recovered", recover_json(F.col("response"), kind))
    good = tried.where("recovered is not null")
    if schema is not None:
        good = good.withColumn("parsed", F.from_json("recovered", schema))
    bad = tried.where("recovered is null").drop("recovered").withColumn("length", F.length("response"))
    return good, bad


def validate_rounds(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Validation status per analysis from its rounds, one row each.

    ``rounds`` is (keys, template_status, has_article, name, response, error). The first failing
    checks are named in the reason.
    """
    fine = F.col("error").isNull()
    marked = F.lit(False)
    for marker in ERROR_MARKERS:
        marked = marked | F.contains("response", F.lit(marker))
    grouped = rounds.groupBy(*keys).agg(
        F.max("template_status").alias("template_status"),
        F.max(F.coalesce("has_article", F.lit(False))).alias("has_article"),
        (F.count("name") > 0).alias("has_rounds"),
        *[F.max(F.coalesce((F.col("name") == r) & fine, F.lit(False))).alias(f"_{r}") for r in REQUIRED_ROUNDS],
        (~F.max(F.coalesce(marked, F.lit(False)))).alias("no_llm_errors"),
    )
    required = F.lit(True)
    for r in REQUIRED_ROUNDS:
        required = required & F.col(f"_{r}")
    checked = grouped.withColumn("required_fields", required)
    checks = ["has_article", "has_rounds", "required_fields", "no_llm_errors"]
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]))
    testing = F.coalesce("template_status", F.lit("TESTING")) == "TESTING"
    return checked.withColumn("_failed", failed).select(
        *keys, *checks,
        F.when(testing, "REVIEW").when(F.size("_failed") > 0, "FAILED").otherwise("VALID").alias("status"),
        F.when(testing, "Testing template requires human review")
        .when(F.size("_failed") > 0, F.concat(F.lit("Failed validation checks: "), F.array_join("_failed", ", ")))
        .otherwise("Passed all validation checks")
        .alias("reason"),
    )
