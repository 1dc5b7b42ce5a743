"""Quality rules: fixed limits, then an isolation forest over the rule statistics.

Random splits isolate an unusual point after few steps, so anomalies have short paths. The forest is grown on labelled rows,
good and bad: a statistic that is constant among good rows could never be split on otherwise. Most rows are good, so bad ones
are the anomalies. The limit on the anomaly score comes from all clean labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import keep, over_texts, text_or_empty, texts_of
from cairnspark.llm.text_stats import COUNTS, counts

TREES, SUBSAMPLE, SEED = 200, 256, 11
#: Labelled rows that the forest is grown on, at most: each tree draws SUBSAMPLE of them.
TRAIN_ROWS = 5000
#: Share of clean labelled rows that the limit must keep.
KEEP_CLEAN = 0.995
#: Statistics of the forest: a count, what it is a share of, the share and the size that an empty text is taken to have. Short
#: texts have extreme shares by chance; the prior pulls them in.
SHARES = (
    ("n_symbols", "word_chars", 0.0, 100), ("n_pipes", "n_words", 0.0, 20), ("n_upper", "word_chars", 0.03, 100),
    ("n_marks", "n_words", 0.0, 20), ("n_adjacent", "n_words", 0.005, 20), ("n_distinct", "n_words", 0.8, 20),
)
BINS = 4096  # of the score histogram by which the limit is found
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def shares(count: np.ndarray) -> np.ndarray:
    """SHARES, one row for each row of counts."""
    c = dict(zip(COUNTS, np.asarray(count, float).reshape(-1, len(COUNTS)).T, strict=True))
    return np.stack([(c[part] + share * size) / (c[whole] + size) for part, whole, share, size in SHARES], axis=1)


@dataclass
class Forest:
    """Complete binary trees as arrays, a row a tree: feature (-1: leaf), split, and the depth that a leaf stands for."""

    feature: np.ndarray
    split: np.ndarray
    depth: np.ndarray
    size: int

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        rng, size = np.random.default_rng(seed), min(subsample, len(rows))
        height = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = (1 << (height + 1)) - 1
        feature, split, depth = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            stack = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
            while stack:
                at, level, part = stack.pop()
                lo, hi = part.min(0), part.max(0)
                able = np.flatnonzero(hi > lo)
                if level == height or len(part) < 2 or not len(able):
                    depth[t, at] = level + path_length(len(part))
                    continue
                f = feature[t, at] = rng.choice(able)
                split[t, at] = rng.uniform(lo[f], hi[f])
                left = part[:, f] < split[t, at]
                # an empty side is a leaf: nothing of the sample went there, a new point may
                for side, sub in ((2 * at + 1, part[left]), (2 * at + 2, part[~left])):
                    if len(sub):
                        stack.append((side, level + 1, sub))
                    else:
                        depth[t, side] = level + 1
        return cls(feature, split, depth, size)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected path length): near 1 for anomalies, below 0.5 for ordinary rows."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, depth in zip(self.feature, self.split, self.depth, strict=True):
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                right = rows[every, np.maximum(feature[at], 0)] >= split[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += depth[at]
        return 2.0 ** (-total / len(self.feature) / max(float(path_length(self.size)), 1e-9))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS, one row for each row of docs; a null text is empty."""
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([counts(t) for t in texts_of(batch)], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(found.T))], ["doc_id", *COUNTS])

    return over_texts(picked, rows, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _limit(labelled: DataFrame, keep_clean: float) -> float:
    """The lowest score limit that keeps this share of clean rows, from exact counts by bin: all labelled rows, BINS numbers."""
    cells = labelled.groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n")).collect()
    clean = np.zeros(BINS)
    for r in cells:
        clean[r["bin"]] = r["n"]
    if not clean.sum():
        return 1.0
    return float((np.searchsorted(np.cumsum(clean), keep_clean * clean.sum()) + 1) / BINS)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def grow(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_clean: float = KEEP_CLEAN) -> tuple[DataFrame, Forest | None, float]:
    """All rows of docs as (doc_id, COUNTS, base_failed, anomaly), the forest (None without labelled rows), and the limit."""
    spark = docs.sparkSession
    stats = keep(statistics(docs, id_col, text_col).withColumn("base_failed", _base_failed()), "statistics")
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = keep(stats.where("not base_failed").join(marked, "doc_id"), "labelled")
    sample = known.orderBy(F.xxhash64("doc_id"), *COUNTS).limit(TRAIN_ROWS).select(*COUNTS).collect()
    if not sample:
        return stats.withColumn("anomaly", F.lit(0.0)), None, 1.0
    forest = Forest.grow(shares(np.array(sample)))
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(shares(np.stack([c.to_numpy() for c in columns], axis=1))))

    limit = _limit(known.where("quality = 1").select(anomaly(*COUNTS).alias("anomaly")), keep_clean)
    return stats.withColumn("anomaly", anomaly(*COUNTS)), forest, limit


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_clean: float = KEEP_CLEAN) -> DataFrame:
    """One row for each row of docs: doc_id, COUNTS, base_failed, anomaly, kept.

    labels (doc_id, quality) marks clean rows with quality 1. Rows that fail a fixed limit are not kept and not learned from.
    Without labelled rows no forest can be grown: anomaly is 0 and the fixed limits alone decide, as they do without clean ones. Null and empty texts
    have no words and fail. Repeated rows are judged alike; null ids are judged but never match a label.
    """
    scored, _, limit = grow(docs, labels, id_col, text_col, keep_clean)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def filter_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that are not kept.

    Every row is judged by its own text, so rows with a null id are kept or go like any, and of rows that share an id each has its
    own verdict. Nothing is joined, and columns of docs may have any names.
    """
    _, forest, limit = grow(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        found = np.array([counts(t.encode()) for t in texts], np.int64).reshape(-1, len(COUNTS))
        words, repeated = (found[:, COUNTS.index(c)] for c in ("n_words", "n_repeat_words"))
        kept = (words >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT_PERCENT * words)
        return pd.Series(kept & (shared.value.scores(shares(found)) < limit) if shared.value else kept)

    return docs.where(good(text_or_empty(text_col)))
