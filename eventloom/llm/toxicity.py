"""Toxicity from class-conditional Kneser-Ney models.

One character model reads toxic, one ordinary documents (``kneser_ney``, the lowest orders
shared). A word's evidence is the difference of its log-probabilities; a document's are length-
normalised: the mean over the whole text, the highest mean over any ``WINDOWS`` words in a row (so a
few toxic sentences in a long text count as much as in a short one) and the mean of its three
strongest words. A logistic function of these, fitted to documents that the models have not read,
turns them into the score.

Learning: models read all labelled documents whose fold is in ``READ``, calibration a sample of
about ``SAMPLE`` documents of fold ``CALIBRATE`` (chosen by a hash of the id); fold 0 is never read.

Scale: one pass over the labelled texts and one scan for scoring, no shuffle of texts while the labels
fit a broadcast. Models hold every distinct n-gram and lie in the shared folder.

Defined results: null and empty texts have no evidence and get the score that evidence zero gets.
Without labels of both classes all scores are the share of toxic labels (0 without any). Rows with
null or repeated ids are rows like others (a null id is never learned from); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from eventloom.llm import kneser_ney
from eventloom.llm.common import Memo, fold, in_worker, labelled, sample, slices, table

ORDER, BITS, SHARED = 5, 64, 2
WINDOWS = (4, 16, 64)
READ, CALIBRATE = (1, 2, 3), 4
SAMPLE = 20_000
CLIP = 20.0  # evidence of one word


def _memo(key: str, model) -> Memo:
    def evidence(words: list[str]) -> np.ndarray:
        found = model.score(words)
        return np.clip(found[:, 1] - found[:, 0], -CLIP, CLIP)

    return in_worker(key, lambda: Memo(evidence, 200_000))


def features(memo: Memo, texts: list[str]) -> np.ndarray:
    """Mean, highest window means and mean of the three strongest words of each text."""
    out = np.zeros((len(texts), 2 + len(WINDOWS)))
    lists = [kneser_ney.words_of(t) for t in texts]
    words = [w for x in lists for w in x]
    values, at = (memo.rows(words) if words else np.zeros(0)), 0
    for i, x in enumerate(lists):
        v, at = values[at : at + len(x)], at + len(x)
        if not len(v):
            continue
        total = np.r_[0, np.cumsum(v)]
        out[i, 0] = total[-1] / len(v)
        for k, w in enumerate(WINDOWS, 1):
            out[i, k] = ((total[w:] - total[:-w]).max() if len(v) > w else total[-1]) / w
        out[i, -1] = np.sort(v)[-3:].sum() / 3
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression (last one the bias) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """``score`` is a column function; models are fitted when the object is made."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "toxic"):
        known = labelled(docs, labels, label, fold(docs["doc_id"], 5)).filter(F.col("fold") != 0)
        model = kneser_ney.fit(
            known.filter(F.col("fold").isin(*READ)).select("text", F.col("y").alias("cls")), 2, ORDER, BITS, SHARED
        )
        key = uuid.uuid4().hex

        def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memo = _memo(key, model)
            for batch in batches:
                found = [features(memo, some) for some in slices(batch["text"])]
                yield pd.DataFrame({"y": batch["y"].to_numpy(), "x": list(np.concatenate(found)) if found else []})

        some = sample(known.filter(F.col("fold") == CALIBRATE), "id", SAMPLE).select("text", "y")
        got = some.mapInPandas(evidence, "y int, x array<double>").toPandas()
        y = got["y"].to_numpy(float)
        self.constant, scale, weights = None, None, None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
        else:
            x = np.stack(got["x"].to_numpy())
            scale = np.maximum(x.std(axis=0), 1e-9)
            weights = logistic(x / scale, y)

        @pandas_udf(DoubleType())
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            memo = _memo(key, model)
            for batch in batches:
                parts = [features(memo, some) / scale @ weights[:-1] + weights[-1] for some in slices(batch)]
                yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -30, 30))))

        self._udf = score

    def score(self, text: Column) -> Column:
        return F.lit(self.constant) if self.constant is not None else self._udf(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = Scorer(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(docs["doc_id"], 5) == 0).alias("held_out"), scorer.score(docs["text"]).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
