"""Scans over the lines of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.codec import posix_to_java
from cairnspark.operators.compare import lines


def numbered(files: DataFrame) -> DataFrame:
    """files (path, text, ...) to path, line_no from 1, line."""
    return files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """Lines that an extended POSIX pattern matches. Texts without a match anywhere are not split into lines."""
    java = posix_to_java(pattern)
    return numbered(files.where(F.col("text").rlike(f"(?m){java}"))).where(F.col("line").rlike(java))


def line_counts(files: DataFrame) -> DataFrame:
    return files.select("path", F.size(lines(F.col("text"))).cast("bigint").alias("n_lines"))


def blame_head(files: DataFrame, head: str) -> DataFrame:
    """Every line put down to one commit."""
    return numbered(files).withColumn("commit", F.lit(head))


def blame_first(history: DataFrame) -> DataFrame:
    """history (path, seq, text): for each line of a path's last version, the first version that has the line anywhere."""
    rows = history.select("path", "seq", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    first = rows.groupBy("path", "line").agg(F.min("seq").alias("first_seq"))
    last = history.groupBy("path").agg(F.max("seq").alias("seq"))
    return rows.join(last, ["path", "seq"]).join(first, ["path", "line"]).select("path", (F.col("at") + 1).alias("line_no"), "line", "first_seq")
