"""Stored metric index: exact nearest neighbours that read only the cells which can hold one.

Every vector belongs to the cell of its nearest pivot. Cells are partitions of the table, rows are
sorted by their distance to the pivot, and a small table keeps each cell's smallest and largest
distance and its number of items by type. By the triangle inequality a vector within ``t`` of a query
lies in a cell whose ring of distances comes within ``t`` of the query's own distance to the pivot,
and inside that cell in the band of width ``2 t``; cells and bands are partition and Parquet filters.

Scale: pivots are at most ``PIVOTS`` per vector length, the rows of smallest id hash, chosen once when
the index is created; batches are added without reading stored vectors. How well cells prune depends
on the data: clustered vectors skip most of the table, evenly spread ones of many dimensions few.
Results never depend on it.

Defined results: those of ``operators.vectors.search`` over all rows added. Null and empty vectors are
kept in no cell that a search reads; vectors with null or non-finite components lie in a cell of their own
that is always read. Lengths without a pivot (first met in a later batch) do too. An empty index finds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vectors import search, squared_distance

PIVOTS = 64
LOOSE = -1  # the cell of vectors that no distance bound holds for
SLACK = 1e-9  # relative rounding allowance of the bounds; distances themselves are compared exactly
CELLS = "dim int, cell int, item_type string, items bigint, nearest double, farthest double"


def _finite():
    e = F.col("embedding")
    return ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _pivots(vectors: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct vectors of each length, by the hash of their id."""
    usable = vectors.where(F.size("embedding") > 0).where(_finite())
    rows = usable.select(F.size("embedding").alias("dim"), F.xxhash64("item_id").alias("h"), F.col("embedding").cast("array<double>").alias("pivot"))
    first = Window.partitionBy("dim").orderBy("h", "pivot")
    picked = rows.withColumn("cell", F.row_number().over(first)).where(F.col("cell") <= most)
    distinct = picked.groupBy("dim", "pivot").agg(F.min("cell").cast("int").alias("cell"))
    return distinct.select("dim", "cell", "pivot")


def _nearest(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """UDF: cell and distance of the nearest pivot, in double precision."""

    @F.pandas_udf("cell int, to_pivot double")
    def place(embedding: pd.Series) -> pd.DataFrame:
        cell, gap = np.full(len(embedding), LOOSE, np.int32), np.full(len(embedding), np.nan)
        sizes = embedding.map(len).to_numpy()
        for dim, (ids, at) in pivots.items():
            rows = np.flatnonzero(sizes == dim)
            for low in range(0, len(rows), 1024):
                some = rows[low : low + 1024]
                x = np.stack(embedding.iloc[some].to_numpy()).astype(np.float64)
                rough = (at**2).sum(axis=1) - 2 * (x @ at.T)  # ranks pivots; any choice is a valid one
                best = rough.argmin(axis=1)
                cell[some], gap[some] = ids[best], np.sqrt(((x - at[best]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "to_pivot": gap})

    return place


@dataclass
class VectorIndex:
    """An index below ``path``: ``pivots``, ``cells`` and ``vectors`` (by dim and cell)."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS) -> VectorIndex:
        """A new index over (item_id, item_type, embedding); ``vectors`` are its first batch."""
        index = cls(vectors.sparkSession, path)
        _pivots(vectors, pivots).coalesce(1).write.parquet(f"{path}/pivots")
        typed = vectors.select("item_id", "item_type", "embedding", F.lit(0.0).alias("to_pivot"), F.lit("").alias("batch"))
        typed.limit(0).coalesce(1).write.parquet(f"{path}/schema")
        index.add(vectors)
        return index

    def _read_pivots(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = self.spark.read.schema("dim int, cell int, pivot array<double>").parquet(f"{self.path}/pivots").collect()
        by_dim: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["dim"], r["cell"])):
            by_dim.setdefault(r["dim"], []).append(r)
        return {d: (np.array([r["cell"] for r in of], np.int32), np.array([r["pivot"] for r in of])) for d, of in by_dim.items()}

    def add(self, vectors: DataFrame) -> None:
        """Append a batch of new items. Stored vectors are not read."""
        rows = vectors.select("item_id", "item_type", "embedding", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"))
        bounded = (F.col("dim") > 0) & _finite()
        placed = rows.withColumn("at", F.when(bounded, _nearest(self._read_pivots())(F.when(bounded, F.col("embedding")).otherwise(F.array().cast("array<float>")))))
        out = placed.select(
            "item_id", "item_type", "embedding", F.when(F.col("at.cell") != LOOSE, F.col("at.to_pivot")).alias("to_pivot"), "dim",
            F.coalesce("at.cell", F.lit(LOOSE)).alias("cell"),
        )
        batch = f"{self.path}/vectors/batch={uuid.uuid4().hex}"
        spread = out.repartition("dim", "cell", F.pmod(F.xxhash64("item_id"), F.lit(8)))  # a hot cell is eight tasks' work
        spread.sortWithinPartitions("dim", "cell", "to_pivot").write.partitionBy("dim", "cell").parquet(batch)
        added = self.spark.read.schema(spread.schema).parquet(batch)
        summary = added.groupBy("dim", "cell", "item_type").agg(
            F.count(F.lit(1)).alias("items"), F.min("to_pivot").alias("nearest"), F.max("to_pivot").alias("farthest")
        )
        summary.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")

    def vectors(self) -> DataFrame:
        """All stored rows: item_id, item_type, embedding, to_pivot, batch, dim, cell."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("dim", "integer").add("cell", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """Ring and number of items of each cell and type, over all batches."""
        parts = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")
        return parts.groupBy("dim", "cell", "item_type").agg(
            F.sum("items").alias("items"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest")
        )

    def _rings(self, query: np.ndarray, item_type: str | None) -> list[tuple[float, int, int, float | None]]:
        """(lower bound, cell, items, distance to its pivot) of the cells a search may read, nearest first."""
        rows = self.cells().where(F.col("dim") == len(query))
        if item_type is not None:
            rows = rows.where(F.col("item_type") == item_type)
        rings = rows.groupBy("cell").agg(F.sum("items").alias("items"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))
        ids, at = self._read_pivots().get(len(query), (np.zeros(0, np.int32), np.zeros((0, len(query)))))
        own = dict(zip(ids.tolist(), np.sqrt(((at - query) ** 2).sum(axis=1)).tolist()))
        out = []
        for r in rings.collect():  # one row per pivot at most
            d = own.get(r["cell"])
            low = 0.0 if d is None else max(0.0, d - r["farthest"] - _slack(d, r["farthest"]), r["nearest"] - d - _slack(d, r["nearest"]))
            out.append((low, r["cell"], r["items"], d))
        return sorted(out, key=lambda r: (r[0], r[1]))

    def candidates(self, query: Sequence[float], limit: int = 10, item_type: str | None = None) -> DataFrame:
        """Stored rows among which the ``limit`` nearest to the query are: those of the cells and bands that
        reach as far as the ``limit``-th distance found in the nearest cells that hold enough items."""
        q = np.array(query, np.float64)
        rings, stored = self._rings(q, item_type), self.vectors().where(F.col("dim") == len(q))
        held, first = 0, []
        for _, cell, items, d in rings:
            if d is not None:
                held, first = held + items, [*first, cell]
            if held >= limit:
                break
        reach = math.inf
        if held >= limit and np.isfinite(q).all():
            near = stored.where(F.col("cell").isin(first))
            if item_type is not None:
                near = near.where(F.col("item_type") == item_type)
            far = near.select(squared_distance(F.col("embedding"), query).alias("d")).orderBy("d").limit(limit).agg(F.max("d")).first()[0]
            reach = math.sqrt(far) if far is not None else math.inf
        keep, edges = F.lit(False), []
        for low, cell, _, d in rings:
            if low > reach:
                continue
            band = F.lit(True)
            if d is not None and math.isfinite(reach):
                edge = reach + _slack(d, reach)
                band = F.col("to_pivot").between(d - edge, d + edge)
                edges += [d - edge, d + edge]
            keep = keep | ((F.col("cell") == cell) & band)
        cells = [cell for low, cell, _, _ in rings if low <= reach]
        found = stored.where(F.col("cell").isin(cells) if cells else F.lit(False))
        if edges:  # what all bands span, on the stored column alone, so that row groups are skipped by it
            found = found.where(F.col("to_pivot").isNull() | F.col("to_pivot").between(min(edges), max(edges)))
        return found.where(keep)

    def search(self, query: Sequence[float], limit: int = 10, item_type: str | None = None) -> DataFrame:
        """The nearest items with distance and score, as ``operators.vectors.search`` finds them in all rows."""
        rows = self.candidates(query, limit, item_type).select("item_id", "item_type", "embedding")
        return search(rows, query, limit, item_type)

    def similar_to_item(self, item_id, limit: int = 10) -> DataFrame:
        """Neighbours of a stored item, itself left out; none of an unknown one."""
        row = self.vectors().where(F.col("item_id") == item_id).select("embedding").first()
        if row is None or not row["embedding"] or any(c is None for c in row["embedding"]):
            empty = self.vectors().select("item_id", "item_type", F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"))
            return empty.where(F.lit(False))
        found = self.search(row["embedding"], limit + 1)
        return found.where(F.col("item_id") != item_id).orderBy("distance", "item_id").limit(limit)


def _slack(*distances: float) -> float:
    return SLACK * (1.0 + sum(distances))
