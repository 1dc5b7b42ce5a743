"""What the operators of this subpackage share: scratch tables, Arrow batches and joins on keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.scratch import cut as keep
from cairnspark.scratch import drop, shared_folder

__all__ = ["bounded_batches", "drop", "keep", "lookup", "over_texts", "shared_folder", "table", "text_or_empty", "texts_of"]

#: Rows of an Arrow batch at most; texts may be long, and two batches are in memory at a time.
BATCH_ROWS = 1000
#: A key with more than 1/HOT of the weight is hot, so there are fewer than HOT hot keys whatever the input.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, BATCH_ROWS)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def over_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one function call a batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; bytes.lower() changes A-Z only and bytes.split() splits at [\\x20\\x09-\\x0D]+."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def lookup(rows: DataFrame, uniques: DataFrame, key: str, weight: str, total: int, by: str = "doc_id", salts: int | None = None, merge: bool = False) -> DataFrame:
    """rows LEFT JOIN uniques on key, where uniques has each key once and a few keys may own most of the rows.

    weight: the column of uniques that tells about how many rows have the key; total: the sum of all weights, or more; by: a
    column of rows that tells the rows of a key apart, by which they are dealt out. Hot keys are fewer than HOT by arithmetic, so the
    set that is broadcast is bounded. Their rows get a salt, their entries in uniques are repeated once a salt; all other keys join as
    usual, and always by a merge if uniques is known to grow with rows.
    """
    spark = rows.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.col(weight) > F.lit(max(total, 1) / HOT)
    hot = uniques.where(is_hot).select(F.col(key).alias("__hot"))
    dealt = rows.join(F.broadcast(hot), rows[key] == hot["__hot"], "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(F.col(f"`{by}`")), F.lit(salts)).cast("int")).otherwise(0)
    ).drop("__hot")
    copies = uniques.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies.hint("merge") if merge else copies, [key, "__salt"], "left").drop("__salt")
