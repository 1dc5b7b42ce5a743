"""Exact deduplication in two passes over Bloom filters.

Pass one: every task sets the bits of its rows' hashes in two bit arrays, `once` (seen) and `twice` (seen again: the bit was
set already). The arrays of all tasks are merged block by block; a bit that two tasks have set counts as seen again.
Pass two: a row whose bits are all in `twice` may have a copy. Only such rows are shuffled, where an exact count decides.
All other rows pass straight through.

A filter has a fixed size limit, so it can be broadcast whatever the input. A corpus with more rows than one filter serves is
taken in ranges of the hash, each with a filter of its own: the rows are written once with their digests, in the order of the
ranges inside each task, and every range then reads its own rows only. No range shuffles a row that its filter clears.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnspark.llm.common import bounded_batches, keep, lookup, over_texts, shared_folder, text_or_empty, texts_of

BITS_A_ROW = 16
PROBES = 4
MIN_BITS, MAX_BITS = 1 << 19, 1 << 29
BLOCK_WORDS = 1 << 13  # of 64 bits: the unit in which filters are merged
FILTER_TASKS = 64  # partial filters of a range at most, so that merging is bounded too: half a million rows each in a full range
MOST_AT_ONCE = 16  # ranges in work at a time at most, as the driver holds a filter of each


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.lower()).digest()


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text in UTF-8 with A-Z lower-cased. A null text is empty."""
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(t) for t in texts_of(batch)], pa.binary())], ["doc_id", "digest"])

    return over_texts(picked, rows, "doc_id long, digest binary")


def probes(values: list[bytes], bits: int) -> np.ndarray:
    """PROBES bit positions of each digest, one row a digest."""
    halves = np.frombuffer(b"".join(v[:16] for v in values), np.uint64).reshape(-1, 2)
    step = halves[:, 1] | np.uint64(1)
    return (halves[:, :1] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def seen_again(hashed: DataFrame, n_rows: int) -> np.ndarray:
    """The merged `twice` array of a table of digests, of a range at most."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (max(1, n_rows) * BITS_A_ROW - 1).bit_length()))

    def partial(batches):
        once, twice = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
        for batch in batches:
            where, count = np.unique(probes(batch.column(0).to_pylist(), bits), return_counts=True)
            word, bit = (where >> np.uint64(6)).astype(np.int64), np.uint64(1) << (where & np.uint64(63))
            again = (count > 1) | ((once[word] & bit) != 0)
            np.bitwise_or.at(twice, word[again], bit[again])
            np.bitwise_or.at(once, word, bit)
        for block in range(bits // 64 // BLOCK_WORDS):
            part = slice(block * BLOCK_WORDS, (block + 1) * BLOCK_WORDS)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([once[part].tobytes()]), pa.array([twice[part].tobytes()])], ["block", "once", "twice"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(BLOCK_WORDS, np.uint64), np.zeros(BLOCK_WORDS, np.uint64)
        for a, b in zip(parts["once"], parts["twice"], strict=True):
            seen = np.frombuffer(a, np.uint64)
            twice |= np.frombuffer(b, np.uint64) | (once & seen)
            once |= seen
        return pd.DataFrame({"block": parts["block"].iloc[:1], "twice": [twice.tobytes()]})

    merged = hashed.select("digest").coalesce(FILTER_TASKS).mapInArrow(partial, "block int, once binary, twice binary").groupBy("block").applyInPandas(merge, "block int, twice binary")
    out = np.zeros(bits // 64, np.uint64)
    for row in merged.collect():  # MAX_BITS / 8 bytes at most
        out[row["block"] * BLOCK_WORDS : (row["block"] + 1) * BLOCK_WORDS] = np.frombuffer(row["twice"], np.uint64)
    return out


def maybe_repeated(shared: Broadcast, column: Column) -> Column:
    """True where a digest may occur more than once; false means that it occurs once."""

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        twice = shared.value
        at = probes(values.tolist(), len(twice) * 64)
        return pd.Series(((twice[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1) if len(values) else [], dtype=bool)

    return test(column)


def _settle(digests: DataFrame, rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """rows (digest, doc_id, ...) that the filter clears, and the others with keep_id, group_size and n_top, the number of rows
    that repeat the id that stays; null where the exact count has found the digest once."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(seen_again(digests, n_rows))
    flag = lambda df: df.withColumn("maybe", maybe_repeated(shared, F.col("digest")))
    by_id = flag(digests).where("maybe").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "doc_id"), F.sum("n")).alias("n_top"))
    groups = keep(by_text.where("group_size > 1"), "groups")
    flagged = flag(rows)
    return flagged.where("not maybe").drop("maybe"), lookup(flagged.where("maybe").drop("maybe"), groups, "digest", "group_size", n_rows)


def _by_ranges(hashed: DataFrame, finish: Callable[[DataFrame, DataFrame], DataFrame], again: DataFrame | None = None) -> DataFrame:
    """finish(cleared, tested) of all rows of hashed (digest, doc_id, ...), range by range if one filter is too small.

    again: what gives the rows once more, with more columns; without it, the digests are the rows.
    """
    spark = hashed.sparkSession
    bounded_batches(spark)
    digests = keep(hashed.select("doc_id", "digest"), "digests")
    n_rows = digests.count()
    ranges = max(1, -(-n_rows * BITS_A_ROW // MAX_BITS))
    if ranges == 1:
        return finish(*_settle(digests, digests if again is None else again, n_rows))
    # the last bytes of a digest give its range, as the first ones give the places in a filter
    nth = (F.conv(F.hex(F.substring("digest", -4, 4)), 16, 10).cast("long") * ranges / (1 << 32)).cast("int")
    sorted_ = keep((digests if again is None else again).withColumn("nth", nth).sortWithinPartitions("nth"), "ranges")
    sizes = {r["nth"]: r["n"] for r in sorted_.groupBy("nth").agg(F.count("*").alias("n")).collect()}  # one row a range
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"

    def one(k: int) -> StructType:
        rows = sorted_.where(F.col("nth") == k).drop("nth")
        out = finish(*_settle(rows.select("doc_id", "digest"), rows, sizes[k]))
        out.write.parquet(f"{path}/nth={k}")
        return out.schema

    with ThreadPoolExecutor(max(1, min(MOST_AT_ONCE, spark.sparkContext.defaultParallelism // FILTER_TASKS))) as pool:
        schemas = list(pool.map(one, sizes))
    return spark.read.schema(schemas[0]).parquet(*[f"{path}/nth={k}" for k in sizes])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, and empty texts equal one another. The largest
    id of a group stays; null ids come last, and a group of null ids only has a null keep_id. Rows that repeat both id and
    text get the same verdict (exact_dedup lets one of them through). An empty table gives an empty result.
    """

    def finish(cleared: DataFrame, tested: DataFrame) -> DataFrame:
        alone = cleared.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
        once = F.col("group_size").isNull()
        return alone.union(tested.select(
            "doc_id", F.when(once, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (once | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest",
        ))

    return _by_ranges(digests(docs, id_col, text_col), finish)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: that of the largest id.

    Rows that the filter clears are never shuffled. Of rows that repeat the id and the text, one stays, whichever. Rows travel
    in one struct, so columns of docs may have any names.
    """

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(t.encode()) for t in texts], dtype=object)

    def finish(cleared: DataFrame, tested: DataFrame) -> DataFrame:
        left = tested.where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
        single, repeated = left.where("coalesce(n_top, 1) = 1"), left.where("n_top > 1").dropDuplicates(["digest"])
        return cleared.select("row").union(single.select("row")).union(repeated.select("row"))

    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), hashed(text_or_empty(text_col)).alias("digest"))
    return _by_ranges(digests(docs, id_col, text_col), finish, rows).select("row.*")
