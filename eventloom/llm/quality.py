"""Quality from document statistics: random Fourier features, ridge regression, isotonic calibration.

``STATISTICS`` of a text (lengths, kinds of characters, repetition) are standardised; ``WIDTH`` random
cosines of them approximate a Gaussian kernel. Tasks add up the normal equations of their rows and the
sums are added by position; the solution is a ridge regression of the label. Pool-adjacent-violators
calibration on rows outside the fit turns its value into a probability that does not fall.

Learning: a sample of about ``SAMPLE`` labelled documents (chosen by a hash of the id) of folds 1 to 4;
fold ``CALIBRATE`` calibrates, the others fit; fold 0 is never read. The sample's ids are bounded, so
they are broadcast and no text is shuffled.

Scale: statistics of the sample are a written table; the equations are ``WIDTH`` squared numbers per
task, of at most ``TASKS`` tasks. Scoring is one scan without a shuffle; a worker holds one text's words.

Defined results: null and empty texts have zero statistics and are scored like any other. Without
labels of both classes all scores are the share of good labels (0 without any). Rows with null or
repeated ids are rows like others (a null id is never learned from); an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from eventloom.llm.common import fold, labelled, sample, table
from eventloom.session import cut

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "distinct", "top_share", "equal_neighbours", "distinct_pairs",
    "letters", "capitals", "digits", "white", "marks", "odd_marks", "marked_words", "repeated_lines", "line_length", "lone_marks",
)
WIDTH, BANDWIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 7
SAMPLE, TASKS, CALIBRATE = 50_000, 16, 4


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    chars, words, lines = len(text), text.split(), text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.bincount(np.minimum(codes, 128), minlength=129)
    digits, upper, lower = low[48:58].sum(), low[65:91].sum(), low[97:123].sum()
    white = low[9:14].sum() + low[32]
    marks = low[33:127].sum() - digits - upper - lower
    usual = low[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    out[0], out[8:14] = np.log1p(chars), np.array(
        [upper + lower + low[128], upper, digits, white, marks, marks - usual]
    ) / chars
    out[15] = 1 - len(set(lines)) / len(lines)
    out[16] = np.log1p(chars / len(lines))
    if words:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        index: dict[str, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        out[1], out[2], out[3] = np.log1p(n), lengths.mean(), lengths.std()
        out[4] = len(index) / n
        out[5] = np.bincount(ids).max() / n
        out[6] = (ids[1:] == ids[:-1]).sum() / n
        out[7] = len(np.unique(ids[:-1] * len(index) + ids[1:])) / n
        out[14] = sum(not w[-1].isalnum() for w in words) / n
        out[17] = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    return out


def stacked(texts) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(STATISTICS)))


class Features:
    """Standardised statistics and their random cosines; drawn from a fixed seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.maximum(spread, 1e-6)
        self.w = draw.standard_normal((len(STATISTICS), WIDTH)) / BANDWIDTH
        self.b = draw.uniform(0, 2 * np.pi, WIDTH)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / WIDTH), np.ones(len(x))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators); equal x share a value."""
    order = np.argsort(x, kind="stable")
    means: list[list[float]] = []  # value, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if means and means[-1][3] == a:
            m = means[-1]
            m[0], m[1] = (m[0] * m[1] + b) / (m[1] + 1), m[1] + 1
        else:
            means.append([b, 1.0, a, a])
        while len(means) > 1 and means[-2][0] >= means[-1][0]:
            v, w, _, last = means.pop()
            m = means[-1]
            m[0], m[1], m[3] = (m[0] * m[1] + v * w) / (m[1] + w), m[1] + w, last
    # shrink towards the overall share by one row, so that no block claims certainty
    share = float(y.mean())
    values = [(v * w + share) / (w + 1) for v, w, _, _ in means]
    knots = [(edge, v) for (_, _, first, last), v in zip(means, values) for edge in ((first, last) if first < last else (first,))]
    return np.array([k for k, _ in knots]), np.maximum.accumulate(np.array([v for _, v in knots]))


class Scorer:
    """``score`` is a column function; the model is fitted when the object is made."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "quality"):
        ids = labels.filter(fold(labels["doc_id"], 5) != 0).select("doc_id", label)
        ids = cut(sample(ids, "doc_id", SAMPLE))
        known = labelled(docs, ids, label, fold(docs["doc_id"], 5))

        def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"y": batch["y"], "fold": batch["fold"], "x": list(stacked(batch["text"]))})

        rows = cut(known.select("y", "fold", "text").mapInPandas(describe, "y int, fold long, x array<double>"))
        self.constant, features, weights, knots, values = None, None, None, None, None
        low, high, share = rows.agg(F.min("y"), F.max("y"), F.avg("y")).first()
        if low is None or low == high:
            self.constant = float(share or 0.0)
        else:
            fit = rows.filter(F.col("fold") != CALIBRATE)
            at = [F.col("x")[i] for i in range(len(STATISTICS))]
            moments = fit.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
            moments = np.array([m or 0.0 for m in moments])
            features = Features(moments[: len(STATISTICS)], moments[len(STATISTICS) :])
            weights = self._solve(fit, features)
            held = rows.filter(F.col("fold") == CALIBRATE).select("y", "x").toPandas()
            if len(held):
                knots, values = isotonic(features(np.stack(held["x"].to_numpy())) @ weights, held["y"].to_numpy(float))
            else:
                knots, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

        @pandas_udf(DoubleType())
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                parts = [
                    np.interp(features(stacked(batch.iloc[at : at + 1_000])) @ weights, knots, values)
                    for at in range(0, len(batch), 1_000)
                ]
                yield pd.Series(np.concatenate([np.zeros(0), *parts]))

        self._udf = score

    @staticmethod
    def _solve(fit: DataFrame, features: Features) -> np.ndarray:
        """Ridge weights from normal equations that each task adds up over its rows."""

        def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((WIDTH + 1, WIDTH + 2))
            for batch in batches:
                if len(batch):
                    z = features(np.stack(batch["x"].to_numpy()))
                    total += z.T @ np.column_stack([z, batch["y"].to_numpy(float)])
            yield pd.DataFrame({"i": np.arange(WIDTH + 1), "row": list(total)})

        parts = fit.select("x", "y").coalesce(TASKS).mapInPandas(equations, "i int, row array<double>")
        sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros((WIDTH + 1, WIDTH + 2))
        total[sums["i"], sums["j"]] = sums["v"]
        gram = total[:, :-1]
        return np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1.0) * np.eye(WIDTH + 1) / WIDTH, total[:, -1])

    def score(self, text: Column) -> Column:
        return F.lit(self.constant) if self.constant is not None else self._udf(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = Scorer(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(docs["doc_id"], 5) == 0).alias("held_out"), scorer.score(docs["text"]).alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))
