"""Order-dependent work that never brings one key's rows into one task.

Rows are range-partitioned by (keys, order) into blocks; windows run inside a block, and only
one summary row per (key, block) crosses blocks. The blocked frame is written to the shared
folder first: block borders come from sampling and must be the same for both readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def join_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_by_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"_by_{k}"])
    return left.join(renamed, on, how).drop(*[f"_by_{k}" for k in keys])


def blocks(df: DataFrame, keys: list[str], order: list[str], count: int | None = None) -> DataFrame:
    """Add ``_block``, increasing along (keys, order). ``order`` should be unique within a key."""
    n = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
    return cut(ranged.withColumn("_block", F.spark_partition_id()))


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Add running totals (this row included) of each expression per key, in order."""
    marked = df
    for name, expr in sums.items():
        marked = marked.withColumn(name, expr.cast("bigint"))
    blocked = blocks(marked, keys, order)
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = join_by(blocked, offsets, [*keys, "_block"])
    for name in sums:
        out = out.withColumn(name, F.col(f"_before_{name}") + F.sum(name).over(inside))
    return out.drop("_block", *[f"_before_{n}" for n in sums])


def ranks(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Exact position of each row within its key, counted from 1."""
    return running_sums(df, keys, order, {name: F.lit(1)})


def with_next(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``next``: a struct of ``columns`` of the following row of the same key, or null."""
    blocked = blocks(df, keys, order)
    row = F.struct(*columns)
    heads = blocked.groupBy(*keys, "_block").agg(F.min_by(row, F.struct(*order)).alias("_head"))
    following = heads.select(
        *keys, "_block", F.lead("_head").over(W.partitionBy(*keys).orderBy("_block")).alias("_head")
    )
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    return (
        join_by(blocked.withColumn("_next", F.lead(row).over(inside)), following, [*keys, "_block"])
        .withColumn("next", F.coalesce("_next", "_head"))
        .drop("_block", "_next", "_head")
    )


def with_nearest(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], wanted: Column, filled: bool = False
) -> DataFrame:
    """Add ``before`` and ``after``: structs of ``columns`` of the nearest other rows of the same key
    that are ``wanted``, however many that are not lie between; or null.

    ``filled`` says that no key is null: the blocks' summaries are then joined on plain equality, for which
    the rows lie, and are sorted, as the windows left them."""
    blocked = blocks(df.withColumn("_wanted", F.coalesce(wanted, F.lit(False))), keys, order)
    row, at = F.when(F.col("_wanted"), F.struct(*columns)), F.when(F.col("_wanted"), F.struct(*order))
    ends = blocked.groupBy(*keys, "_block").agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))

    def latest(column: Column, window: W) -> Column:
        return F.last(column, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))

    # both directions read preceding rows: a frame of following rows is read anew for each row
    down, up = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]
    across = ends.select(
        *keys, "_block",
        latest(F.col("_last"), W.partitionBy(*keys).orderBy("_block")).alias("_last"),
        latest(F.col("_first"), W.partitionBy(*keys).orderBy(F.desc("_block"))).alias("_first"),
    )
    inside = W.partitionBy(*keys, "_block")
    near = blocked.withColumn("_before", latest(row, inside.orderBy(*down))).withColumn(
        "_after", latest(row, inside.orderBy(*up))
    )
    block = [*keys, "_block"]
    return (
        (near.join(across, block) if filled else join_by(near, across, block))
        .withColumn("before", F.coalesce("_before", "_last"))
        .withColumn("after", F.coalesce("_after", "_first"))
        .drop("_block", "_wanted", "_before", "_after", "_last", "_first")
    )
