"""Comparison of snapshots, path by path and line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(index: DataFrame, worktree: DataFrame) -> DataFrame:
    """One row for each path of either side. Contents are compared by id; modes are shown, not compared."""
    old = index.where("stage = 0").select("path", F.col("oid").alias("index_oid"), F.col("mode").alias("index_mode"))
    new = worktree.select("path", F.col("oid").alias("worktree_oid"), F.col("mode").alias("worktree_mode"))
    gone, fresh, same = F.col("worktree_oid").isNull(), F.col("index_oid").isNull(), F.col("index_oid") == F.col("worktree_oid")
    return old.join(new, "path", "full_outer").select(
        "path", F.when(fresh | (~gone & same), "CURRENT").otherwise("INDEX_MODIFIED").alias("index_status"),
        F.when(fresh, "WT_NEW").when(gone, "WT_DELETED").when(same, "CURRENT").otherwise("WT_MODIFIED").alias("worktree_status"), "index_oid", "worktree_oid", "index_mode", "worktree_mode",
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("index_status", "worktree_status").agg(F.count("*").alias("n"))


def untracked(index: DataFrame, worktree: DataFrame) -> DataFrame:
    return worktree.join(index.where("stage = 0").select("path"), "path", "left_anti").select("path", "oid")


def lines(text: Column) -> Column:
    """Lines of a text without a last empty one."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def changed_texts(index: DataFrame, worktree: DataFrame, blobs: DataFrame) -> DataFrame:
    """path, old, new of tracked files whose content differs; a deleted file has no new text."""
    rows = status(index, worktree).where("worktree_status in ('WT_MODIFIED', 'WT_DELETED')").select("path", "index_oid")
    wanted = rows.select("index_oid").distinct()  # so that unchanged payloads are not shuffled twice
    old = blobs.select(F.col("oid").alias("index_oid"), F.decode("data", "UTF-8").alias("old")).join(wanted, "index_oid", "left_semi").dropDuplicates(["index_oid"])
    return rows.join(old, "index_oid").join(worktree.select("path", F.decode("data", "UTF-8").alias("new")), "path", "left").select("path", "index_oid", "old", "new")


def diff_hunks(texts: DataFrame) -> DataFrame:
    """One hunk for each changed file that is still there: its header and the number of lines on both sides."""
    rows = texts.where("new is not null").select("path", F.size(lines(F.col("old"))).alias("n_old"), F.size(lines(F.col("new"))).alias("n_new"))
    at_least = lambda c: F.greatest(F.col(c), F.lit(1))
    return rows.where("n_old + n_new > 0").select("path", "n_old", "n_new", F.format_string("@@ -1,%d +1,%d @@", at_least("n_old"), at_least("n_new")).alias("header"))


def diff_lines(texts: DataFrame) -> DataFrame:
    """All old lines, then all new ones: path, side, line_no, line. Rows, not one text: a file's diff is in nobody's memory."""
    both = texts.where("new is not null")
    side = lambda mark, column: both.select("path", F.lit(mark).alias("side"), F.posexplode(lines(F.col(column))).alias("line_no", "line"))
    return side("-", "old").union(side("+", "new")).withColumn("line_no", F.col("line_no") + 1)


def line_changes(texts: DataFrame) -> DataFrame:
    """Lines by how often each side has them, for those where the numbers differ: a diff of multisets, in one shuffle."""
    rows = diff_lines(texts).groupBy("path", "line").agg(F.count_if(F.col("side") == "-").alias("n_old"), F.count_if(F.col("side") == "+").alias("n_new"))
    return rows.where("n_old <> n_new")


def tree_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two expanded trees (path, oid): added, deleted and modified paths."""
    rows = old.select("path", F.col("oid").alias("old_oid")).join(new.select("path", F.col("oid").alias("new_oid")), "path", "full_outer")
    return rows.where("not (old_oid <=> new_oid)").select("path", F.when(F.col("old_oid").isNull(), "A").when(F.col("new_oid").isNull(), "D").otherwise("M").alias("change"), "old_oid", "new_oid")
