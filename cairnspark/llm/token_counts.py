"""Token counts from an exact histogram of encoded lengths.

The histogram has one row for each length that occurs, however many documents there are. Sums from either end of it answer how
many documents and tokens fit any context limit, what truncation at that limit leaves, and exact quantiles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.byte_bpe import encoder, vocabulary_path
from cairnspark.llm.common import keep, over_texts, text_or_empty

BLOCK = 128  # lengths that one window of the running sums holds


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(length): ids of each text; null or empty: 0."""
    path = vocabulary or vocabulary_path()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(path).ids
        return pa.RecordBatch.from_arrays([pa.array([len(ids(t)) // 4 for t in batch.column(0).to_pylist()], pa.int64())], ["length"])

    return over_texts(docs.select(text_or_empty(text_col).alias("text")), rows, "length long")


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(length, n_docs), counted before the shuffle. It is small and read more than once, so it is kept."""
    return keep(lengths(docs, text_col, vocabulary).groupBy("length").agg(F.count("*").alias("n_docs")), "histogram")


def by_limit(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    n_docs of that length, n_over (longer documents), n_within, tokens_over (all tokens of the longer ones), tokens_within,
    tokens_truncated (total if every document is cut at the limit), quantile (share of documents within the limit).
    An empty table gives no rows. Sums run inside blocks of lengths and then over the blocks' totals, of which there are
    as many as the longest text's tokens fill blocks.
    """
    cells = hist.withColumns({"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("n_docs")})
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("t_after"), F.sum("bd").over(everything).alias("d_all"), F.sum("bt").over(everything).alias("t_all"))
    longer = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"d_in": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)), "t_in": F.coalesce(F.sum("tokens").over(longer), F.lit(0))}).join(blocks, "block")
    over, tokens = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return cells.select(
        F.col("length").alias("context_limit"), "n_docs", over.alias("n_over"), (F.col("d_all") - over).alias("n_within"), tokens.alias("tokens_over"), (F.col("t_all") - tokens).alias("tokens_within"),
        (F.col("t_all") - tokens + over * F.col("length")).alias("tokens_truncated"), ((F.col("d_all") - over) / F.col("d_all")).alias("quantile"),
    )


def truncated_total(limits: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at limit, any number, from the rows of by_limit()."""
    kept = limits.select(F.sum(F.when(F.col("context_limit") <= limit, F.col("context_limit") * F.col("n_docs")).otherwise(F.col("n_docs") * limit))).first()[0]
    return int(kept or 0)


def quantile(limits: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed."""
    return limits.where(F.col("quantile") >= share).select(F.min("context_limit")).first()[0]
