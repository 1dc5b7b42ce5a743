"""The staging index: rows keyed by (path, stage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.scratch import cut

COLUMNS = ("path", "stage", "oid", "mode", "size")


def listing(index: DataFrame, path: str | None = None) -> DataFrame:
    """path, mode as six octal digits, oid, stage; a path filters exactly."""
    rows = index if path is None else index.where(F.col("path") == path)
    return rows.select("path", F.lpad(F.conv(F.col("mode").cast("string"), 10, 8), 6, "0").alias("mode"), "oid", "stage")


def find(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys, ["path", "stage"])


def find_by_oid(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The first path of each id."""
    return index.join(ids.select("oid").distinct(), "oid").groupBy("oid").agg(F.min("path").alias("path"))


def is_valid(path: Column) -> Column:
    """An entry needs a path."""
    return F.coalesce(path != "", F.lit(False))


def nth(index: DataFrame, n: int) -> DataFrame:
    """Entry number n, from 0, in the order of path and stage. Rows are dealt out by ranges of the path; the ranges' sizes tell
    which of them holds the entry, and only that one is numbered."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(index.repartitionByRange(parts, "path", "stage").withColumn("part__", F.spark_partition_id()), "index")
    before = 0
    for row in dealt.groupBy("part__").agg(F.count("*").alias("n")).orderBy("part__").collect():  # one row a range
        if n < before + row["n"]:
            return dealt.where(F.col("part__") == row["part__"]).drop("part__").orderBy("path", "stage").offset(n - before).limit(1)
        before += row["n"]
    return index.limit(0)


def upsert(index: DataFrame, entries: DataFrame) -> DataFrame:
    """entries take the place of rows with the same key."""
    return index.join(entries.select("path", "stage"), ["path", "stage"], "left_anti").select(*COLUMNS).unionByName(entries.select(*COLUMNS))


def remove(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select("path", "stage"), ["path", "stage"], "left_anti").select(*COLUMNS)


def stats(index: DataFrame) -> DataFrame:
    """Entries, conflicts, size, the last modification where there is one (mtime), and a checksum of all entries in any order."""
    mtime = F.max("mtime") if "mtime" in index.columns else F.lit(None).cast("bigint")
    marks = F.bit_xor(F.crc32(F.concat_ws("\0", "path", F.col("stage").cast("string"), "oid").cast("binary")))
    return index.agg(
        F.count("*").alias("entries"), F.count_if(F.col("stage") != 0).alias("conflicts"), F.coalesce(F.bool_or(F.col("stage") != 0), F.lit(False)).alias("has_conflicts"),
        F.sum("size").alias("total_size"), mtime.alias("mtime"), marks.alias("checksum"),
    )


def add_conflicts(index: DataFrame, conflicts: DataFrame) -> DataFrame:
    """conflicts (path, stage 1 to 3, oid, mode, size) replace all stages of their paths."""
    return index.join(conflicts.select("path").distinct(), "path", "left_anti").select(*COLUMNS).unionByName(conflicts.select(*COLUMNS))


def remove_conflicts(index: DataFrame, paths: DataFrame) -> DataFrame:
    return index.join(paths.select("path"), "path", "left_anti").select(*COLUMNS)


def conflicts(index: DataFrame) -> DataFrame:
    """One row for each path in conflict: the ids of ancestor, ours and theirs; null where a side has none."""
    side = lambda n: F.max(F.when(F.col("stage") == n, F.col("oid")))
    return index.where("stage > 0").groupBy("path").agg(side(1).alias("ancestor"), side(2).alias("ours"), side(3).alias("theirs"))


def without_object(index: DataFrame, objects: DataFrame) -> DataFrame:
    return index.join(objects.select("oid"), "oid", "left_anti").select(*COLUMNS)
