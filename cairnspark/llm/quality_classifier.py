"""Quality classifier by Bradley-Terry ranking.

P(document a is better than b) = sigmoid(s(a) - s(b)), s linear in the features of a text. The weights come from preference
pairs, a labelled good document against a bad one, by logistic loss on the difference of their features. A document is
rejected if its score falls below a quantile of the scores of all labelled rows: the share of bad ones among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import keep, over_texts, text_or_empty, texts_of
from cairnspark.llm.text_stats import COUNTS, counts, features

#: Labelled rows of each class that the pairs are drawn from, at most; the quantile covers all labelled rows.
TRAIN_ROWS = 5000
PAIRS, STEPS, PENALTY, SEED = 60_000, 60, 1e-3, 5
CUT = 0.3  # the score that stands for the quantile
BINS = 1 << 16
HELD_OUT = 5  # rows whose crc32(doc_id as text) is divisible by this are never learned from


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def expand(count: np.ndarray) -> np.ndarray:
    """Features for a linear score: the shares, their square roots (small shares of junk matter) and squares."""
    x = features(count)
    return np.hstack([x, np.sqrt(np.abs(x[:, 2:])), x[:, :2] ** 2])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, penalty: float = PENALTY, seed: int = SEED) -> Ranker:
        """Newton's method on the mean logistic loss of feature differences, good minus bad."""
        rng, both = np.random.default_rng(seed), np.vstack([good, bad])
        mean, scale = both.mean(0), both.std(0) + 1e-9
        g, b = (good - mean) / scale, (bad - mean) / scale
        d = g[rng.integers(len(g), size=pairs)] - b[rng.integers(len(b), size=pairs)]
        w = np.zeros(d.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the wrong order
            grad = -d.T @ p / len(d) + penalty * w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) / self.scale @ self.weight


def _quantile(scores: DataFrame, share: float, low: float, high: float) -> float:
    """The score below which this share of the rows lies, from exact counts in BINS bins."""
    width = max(high - low, 1e-9) / BINS
    cells = scores.groupBy(F.greatest(F.lit(0), F.least(F.floor((F.col("raw") - low) / width), F.lit(BINS - 1))).alias("bin")).agg(F.count("*").alias("n")).collect()
    n = np.zeros(BINS)
    for r in cells:
        n[r["bin"]] = r["n"]
    return low + width * float(np.searchsorted(np.cumsum(n), share * n.sum(), "right"))


@dataclass
class Judge:
    """A ranker and the raw score that stands for CUT."""

    ranker: Ranker
    cut: float

    def raw(self, count: np.ndarray) -> np.ndarray:
        return self.ranker.scores(expand(count))


def _value(raw: Column, cut: float) -> Column:
    return 1 / (1 + F.exp(-(raw - F.lit(cut) + F.lit(float(np.log(CUT / (1 - CUT)))))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Judge | None]:
    """All rows of docs as (doc_id, held_out, raw), and what judges them; None if there are not labelled rows of both classes."""
    spark = docs.sparkSession
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([counts(t) for t in texts_of(batch)], np.int32).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(found.T))], ["doc_id", *COUNTS])

    stats = keep(over_texts(picked, rows, "doc_id long, " + ", ".join(f"{c} int" for c in COUNTS)).withColumn("held_out", F.coalesce(crc_of_id() % HELD_OUT == 0, F.lit(False))), "counts")
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = keep(stats.where("not held_out").join(marked, "doc_id").drop("held_out"), "labelled")
    sample = {q: np.array(known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), *COUNTS).limit(TRAIN_ROWS).select(*COUNTS).collect(), float) for q in (0, 1)}
    if not len(sample[0]) or not len(sample[1]):
        return stats.select("doc_id", "held_out", F.lit(0.0).alias("raw")), None
    judge = Judge(Ranker.fit(expand(sample[1]), expand(sample[0])), 0.0)
    shared = spark.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def raw(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.raw(np.stack([c.to_numpy() for c in columns], axis=1)))

    judged = keep(known.select("quality", raw(*COUNTS).alias("raw")), "judged")
    totals = judged.agg(F.avg((F.col("quality") == 0).cast("double")), F.min("raw"), F.max("raw")).first()
    judge.cut = _quantile(judged, *totals)
    return stats.select("doc_id", "held_out", raw(*COUNTS).alias("raw")), judge


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= CUT).

    Only texts enter a score. labels (doc_id, quality) of held-out rows are never used; a doc_id with several labels counts as
    good if any is. Without labelled rows of both classes nothing can be learned: every score is 0.5. Null texts are empty and
    scored like any; null ids are scored, are not held out and never match a label.
    """
    ranked, judge = learn(docs, labels, id_col, text_col)
    if judge is None:
        return ranked.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    value = _value(F.col("raw"), judge.cut)
    return ranked.select("doc_id", "held_out", value.alias("score"), F.when(value >= CUT, 1).otherwise(0).alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without rejected rows.

    Every row is judged by its own text, so rows with a null id are kept or go like any, and of rows that share an id each has its
    own verdict. Nothing is joined, and columns of docs may have any names.
    """
    judge = learn(docs, labels, id_col, text_col)[1]
    if judge is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def raw(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.raw(np.array([counts(t.encode()) for t in texts], np.int32).reshape(-1, len(COUNTS))))

    return docs.where(_value(raw(text_or_empty(text_col)), judge.cut) >= CUT)
