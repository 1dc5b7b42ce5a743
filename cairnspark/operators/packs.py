"""Pack indexes and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADER_BYTES = 12


def running_sum(rows: DataFrame, group: str, bucket: Column, order: list[str], amount: Column, name: str, made: dict[str, Column] | None = None) -> DataFrame:
    """rows with the sum of amount over the rows before, in each group.

    bucket must rise with order, in which nulls come last. Sums run inside a bucket, so that a group that holds most of the rows is not
    in one task; the buckets' totals, which are few, are summed up on their own, and what comes before a bucket goes ahead of its rows as
    a row of its own. So no join is needed, and groups and buckets may be null. Buckets, amounts and columns made of others (made) are
    made where a bucket's rows have met, so that they are not moved; order may name them.
    """
    totals = rows.groupBy(group, bucket.alias("bucket__")).agg(F.sum(amount).alias("total__"))
    before = Window.partitionBy(group).orderBy(F.asc_nulls_last("bucket__")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "bucket__", F.coalesce(F.sum("total__").over(before), F.lit(0)).alias("start__"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    own = F.when(F.col("start__").isNull(), bucket).otherwise(F.col("bucket__"))
    met = both.repartition(F.col(group), own).withColumns({"bucket__": own, "amount__": F.coalesce("start__", amount), **(made or {})})
    inside = Window.partitionBy(group, "bucket__").orderBy(F.asc_nulls_last("start__"), *map(F.asc_nulls_last, order)).rowsBetween(Window.unboundedPreceding, -1)
    summed = met.withColumn(name, F.sum("amount__").over(inside).cast("bigint"))
    return summed.where("start__ is null").drop("bucket__", "amount__", "start__")


def offsets(objects: DataFrame, bucket: Column, order: list[str], size: Column | None = None) -> DataFrame:
    """objects (pack, size, ...) with the byte offset of each in its pack, behind a header, in an order; bucket as above. Objects whose
    size follows from other columns take its making instead, and it is not moved."""
    placed = running_sum(objects, "pack", bucket, order, F.col("size") if size is None else size, "before")
    return placed.withColumn("offset", F.col("before") + HEADER_BYTES).drop("before")


def order(index: DataFrame, oid: Column | None = None) -> DataFrame:
    """Position of each id in its pack's index, from 0. Ids are digests: their first digits make even buckets. An index that holds what
    ids are made of takes their making as oid, and digests are not moved."""
    oid = F.col("oid") if oid is None else oid
    placed = running_sum(index, "pack", F.substring(oid, 1, 2), ["oid", "offset"], F.lit(1), "position", {"oid": oid})
    return placed.select("pack", "oid", "offset", "position")


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("oid"), "oid").select("oid", "pack", "offset")


def stats(index: DataFrame) -> DataFrame:
    return index.groupBy("pack").agg(F.count("*").alias("n_objects"), F.sum("size").alias("total_size"), F.max("offset").alias("last_offset"))


def multi_pack(index: DataFrame) -> DataFrame:
    """Each id once over all packs, from the pack that comes last by name, as newer packs are preferred."""
    best = index.groupBy("oid").agg(F.max(F.struct("pack", "offset")).alias("best"), F.count("*").alias("copies"))
    return best.select("oid", "best.pack", "best.offset", "copies")
