"""Directory trees: built bottom-up from paths, expanded top-down into paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.hashing import object_id
from cairnspark.model import MODE_TREE


def entry_bytes(mode, name, oid):
    """`<octal mode> <name>`, a zero byte, the raw id."""
    return F.concat(F.encode(F.concat(F.conv(mode.cast("string"), 10, 8), F.lit(" "), name), "UTF-8"), F.unhex(F.lit("00")), F.unhex(oid))


def entry_hex(mode, name, oid):
    """entry_bytes() in hex digits: strings can be joined, bytes only appended one by one."""
    return F.concat(F.hex(F.encode(F.concat(F.conv(mode.cast("string"), 10, 8), F.lit(" "), name), "UTF-8")), F.lit("00"), oid)


def build(files: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """files (path, mode, oid) to trees (dir, tree_oid, n_entries) and entries (dir, mode, name, oid) of all directories.

    One aggregation a level, from the deepest up; '' is the root. levels: the number of directories above the deepest file, if
    it is known; otherwise it is looked up. Entries are in the order of their names' bytes. A directory is one group, as its id
    is a digest over all its entries in order. An index with conflicts, entries of a stage above 0, has no tree and is an error.
    """
    if "stage" in files.columns and not files.where("stage > 0").isEmpty():
        raise ValueError("the index has conflicts")
    depth = F.size(F.split("path", "/")) - 1
    if levels is None:
        levels = files.agg(F.max(depth)).first()[0] or 0
    leaf = files.select(depth.alias("depth"), "path", "mode", "oid")
    trees, entries, below = [], [], None
    for level in range(levels, -1, -1):
        here = leaf.where(F.col("depth") == level).select("path", "mode", "oid")
        if below is not None:
            here = here.unionByName(below.select(F.col("dir").alias("path"), F.lit(MODE_TREE).alias("mode"), F.col("tree_oid").alias("oid")))
        name = F.element_at(F.split("path", "/"), -1)
        rows = here.select(F.when(F.lit(level) == 0, "").otherwise(F.substring_index("path", "/", level)).alias("dir"), "mode", name.alias("name"), "oid")
        listed = F.array_sort(F.collect_list(F.struct("name", entry_hex(F.col("mode"), F.col("name"), F.col("oid")).alias("hex"))))
        grouped = rows.groupBy("dir").agg(listed.alias("rows"), F.count("*").alias("n_entries"))
        payload = F.unhex(F.array_join(F.transform("rows", lambda x: x["hex"]), ""))
        below = grouped.select("dir", object_id(F.lit("tree"), payload).alias("tree_oid"), "n_entries")
        trees.append(below)
        entries.append(rows)
    return reduce(DataFrame.unionByName, trees), reduce(DataFrame.unionByName, entries)


def link(trees: DataFrame, entries: DataFrame) -> DataFrame:
    """entries by tree id (tree_oid, mode, name, oid), each tree once, as an object store holds them."""
    return entries.join(trees.select("dir", "tree_oid"), "dir").select("tree_oid", "mode", "name", "oid").distinct()


def expand(roots: DataFrame, tree_entries: DataFrame, levels: int) -> DataFrame:
    """roots (root, tree_oid) to root, path, mode, oid of all files below, down to a number of levels of directories."""
    at, out = roots.select("root", "tree_oid", F.lit("").alias("prefix")), []
    for _ in range(levels + 1):
        rows = at.join(tree_entries, "tree_oid").select("root", F.concat("prefix", "name").alias("path"), "mode", "oid")
        out.append(rows.where(F.col("mode") != MODE_TREE))
        at = rows.where(F.col("mode") == MODE_TREE).select("root", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("prefix"))
    return reduce(DataFrame.unionByName, out)


def entry(tree_entries: DataFrame, trees: DataFrame, name: str) -> DataFrame:
    return trees.select("tree_oid").distinct().join(tree_entries.where(F.col("name") == name), "tree_oid")


# Entries of one tree as an array of structs (mode, name, oid), in the order of names.


def add_entry(entries: Column, new: Column) -> Column:
    """With a new entry, in order; an entry of the same name stays beside it."""
    return F.array_sort(F.concat(entries, F.array(new)), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))


def remove_entry(entries: Column, name: Column) -> Column:
    """Without the first entry of a name."""
    at = F.array_position(F.transform(entries, lambda e: e["name"]), name)
    return F.filter(entries, lambda e, i: (at == 0) | (i != at - 1))


def entry_named(entries: Column, name: Column) -> Column:
    return F.get(F.filter(entries, lambda e: e["name"] == name), F.lit(0))


def entry_nth(entries: Column, n: Column) -> Column:
    """Entry number n from 0; null beyond the end."""
    return F.get(entries, n)
