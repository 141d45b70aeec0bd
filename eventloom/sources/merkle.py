"""Snapshots with a hash tree, compared from the root down.

A snapshot holds one row per key: the key, an order-free digest of its rows, and its bucket, the top
bits of the key's hash. Buckets are the leaves of a tree of fan-out 16 whose nodes carry the sums of
their keys' digests. Two snapshots are compared level by level; only buckets whose digests differ are
read and joined, so equal snapshots cost two rows and few changes cost few buckets.

Scale: the depth grows with the number of keys so that a bucket holds about ``BUCKET`` of them, up to
16 to the power ``DEEPEST`` buckets; a tree of another depth is compared at the shallower one, whose
buckets are unions of the deeper ones. Rows are partitioned by the first two levels (256 folders) and
sorted by bucket. Trees have at most 16/15 times as many rows as buckets.

Defined results: keys may be null (a key like any other) and repeat (their rows count together, in any
order); null values differ from all others; an empty table has an empty tree. Map columns are compared as sets of entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

BUCKET, DEEPEST = 50_000, 5
FOLDERS = 2  # levels that name a row's folder
DIGEST = ["keys", "total", "mixed"]


def _value(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    return F.array_sort(F.map_entries(df[column])) if kind == "map" else df[column]


def _keyed(rows: DataFrame, key: Sequence[str], depth: int) -> DataFrame:
    """One row per key: the key, its digest and its bucket."""
    rest = [c for c in rows.columns if c not in key]
    # a null hashes like no value at all, so each value says whether it is one
    parts = [p for c in rest for p in (rows[c].isNull(), _value(rows, c))] or [F.lit(0)]
    hashed = rows.select(*key, F.xxhash64(*parts, F.lit(1)).alias("h"), F.xxhash64(F.lit(2), *parts).alias("g"))
    per_key = hashed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum_h"), F.sum(F.col("g").cast("decimal(20,0)")).alias("sum_g")
    )
    place = F.xxhash64(*[p for c in key for p in (F.col(c).isNull(), F.col(c))])
    return per_key.select(
        *key,
        F.xxhash64("n", "sum_h", F.lit(3)).alias("digest"),
        F.xxhash64(*key, "n", "sum_g", F.lit(4)).alias("mixed"),
        F.shiftrightunsigned(place, 64 - 4 * depth).cast("int").alias("bucket"),
        F.shiftrightunsigned(place, 64 - 4 * FOLDERS).cast("int").alias("folder"),
    )


def write_snapshot(rows: DataFrame, key: str | Sequence[str], path: str, depth: int | None = None) -> None:
    """Keys, digests and tree of ``rows`` below ``path``."""
    key = [key] if isinstance(key, str) else list(key)
    if depth is None:
        keys = rows.select(F.approx_count_distinct(F.struct(*key))).first()[0]
        depth = FOLDERS
        while depth < DEEPEST and keys > BUCKET * 16**depth:
            depth += 1
    assert FOLDERS <= depth <= DEEPEST, depth
    keyed = _keyed(rows, key, depth)
    keyed.repartitionByRange("bucket").sortWithinPartitions("folder", "bucket").write.partitionBy("folder").parquet(f"{path}/keys")
    keyed.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    stored = rows.sparkSession.read.schema(keyed.schema).parquet(f"{path}/keys")
    leaves = cut(
        stored.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("keys"), F.sum(_wide("digest", "mixed")).alias("total"), F.expr("bit_xor(mixed)").alias("mixed")
        )
    )

    def level(at: int) -> DataFrame:
        node = F.shiftright("bucket", 4 * (depth - at)).alias("node")
        return leaves.groupBy(F.lit(at).alias("level"), node).agg(
            F.sum("keys").alias("keys"), F.sum("total").alias("total"), F.expr("bit_xor(mixed)").alias("mixed")
        )

    tree = reduce(DataFrame.unionAll, [level(at) for at in range(depth + 1)])
    tree.repartition(1, "level").sortWithinPartitions("level", "node").write.parquet(f"{path}/tree")


def _wide(a: str, b: str) -> Column:
    """A sum over keys of a hash of both digests; decimals keep it exact."""
    return F.xxhash64(a, b).cast("decimal(20,0)")


def root(spark: SparkSession, path: str) -> tuple:
    """(keys, total, mixed) of the whole snapshot; zeros if it is empty."""
    row = spark.read.parquet(f"{path}/tree").where("level = 0").select(*DIGEST).first()
    return (0, 0, 0) if row is None else tuple(row)


def differing(spark: SparkSession, left: str, right: str) -> tuple[DataFrame, int]:
    """(buckets whose digests differ, the depth they are of). Each level asks only below nodes that differ."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (left, right)]
    deep = [t.agg(F.max("level")).first()[0] for t in trees]
    depth = min((d for d in deep if d is not None), default=FOLDERS)
    open_ = None
    for at in range(depth + 1):
        a, b = (t.where(F.col("level") == at).select("node", *DIGEST) for t in trees)
        if open_ is not None:
            a, b = (t.join(open_, F.shiftright(t["node"], 4) == open_["parent"], "left_semi") for t in (a, b))
        same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in DIGEST])
        nodes = a.join(b, a["node"] == b["node"], "full_outer").where(~same)
        open_ = cut(nodes.select(F.coalesce(a["node"], b["node"]).alias("parent")))
        if open_.isEmpty():
            break
    return open_.select(F.col("parent").alias("bucket")), depth


def changes(spark: SparkSession, left: str, right: str, key: str | Sequence[str]) -> DataFrame:
    """Keys that differ between two snapshots: key columns and ``change`` (added, removed, changed)."""
    key = [key] if isinstance(key, str) else list(key)
    buckets, depth = differing(spark, left, right)
    folders = [r[0] for r in buckets.select(F.shiftright("bucket", 4 * (depth - FOLDERS))).distinct().collect()]  # 256 at most

    def side(path: str) -> DataFrame:
        keys = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/keys")
        finer = spark.read.parquet(f"{path}/tree").agg(F.max("level")).first()[0]
        near = keys.where(F.col("folder").isin(folders) if folders else F.lit(False))
        near = near.withColumn("at", F.shiftright("bucket", 4 * ((finer or depth) - depth)))
        return near.join(buckets, near["at"] == buckets["bucket"], "left_semi").select(*key, "digest", "mixed")

    a, b = side(left).alias("a"), side(right).alias("b")
    match = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
    both = a.join(b, match, "full_outer")
    in_a, in_b = F.col("a.digest").isNotNull(), F.col("b.digest").isNotNull()
    change = F.when(~in_a, "added").when(~in_b, "removed").when(
        (F.col("a.digest") != F.col("b.digest")) | (F.col("a.mixed") != F.col("b.mixed")), "changed"
    )
    named = both.select(*[F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in key], change.alias("change"))
    return named.where("change is not null")
