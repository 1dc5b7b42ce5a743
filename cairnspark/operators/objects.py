"""Objects by content: dedup, lookup, existence, statistics, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.codec import filter_spec
from cairnspark.functions.hashing import object_id
from cairnspark.model import MODE_TREE
from cairnspark.operators.graph import reachable
from cairnspark.scratch import cut


def with_oid(payloads: DataFrame) -> DataFrame:
    """payloads with oid and size, from type and data."""
    return payloads.withColumns({"oid": object_id(F.col("type"), F.col("data")), "size": F.octet_length("data").cast("bigint")})


def dedup(objects: DataFrame) -> DataFrame:
    """One row an id: oid, type, size, copies. Equal ids have equal content, so any row stands for its group; the sum is
    taken before the shuffle, and payloads are not shuffled at all."""
    return objects.groupBy("oid").agg(F.first("type").alias("type"), F.first("size").alias("size"), F.count("*").alias("copies"))


def write_new(sink: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows of objects that the sink lacks, one an id: writing the same content twice writes nothing. Ids are compared first, so
    that only payloads that are written are brought together."""
    wanted = objects.select("oid").distinct().join(sink.select("oid"), "oid", "left_anti")
    return objects.join(wanted, "oid", "left_semi").dropDuplicates(["oid"])


def remove(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """objects without those of the ids (oid); ids that are not there change nothing."""
    return objects.join(ids.select("oid"), "oid", "left_anti")


def closure(heads: DataFrame, edges: DataFrame, commit_trees: DataFrame, tree_entries: DataFrame, levels: int) -> DataFrame:
    """oid of all that heads (oid) keep alive: commits, their trees (oid, tree_oid), and what these hold."""
    commits = cut(reachable(heads, edges).select("oid").distinct(), "alive")
    return commits.union(held(commits, commit_trees, tree_entries, levels)).distinct()


def held(commits: DataFrame, commit_trees: DataFrame, tree_entries: DataFrame, levels: int) -> DataFrame:
    """oid of the trees of commits (oid) and of what these hold, level by level."""
    trees, out = commits.join(commit_trees, "oid").select(F.col("tree_oid").alias("oid")).distinct(), []
    for _ in range(levels + 1):
        out.append(trees)
        below = trees.withColumnRenamed("oid", "tree_oid").join(tree_entries, "tree_oid").select("oid", "mode").distinct()
        out.append(below.where(F.col("mode") != MODE_TREE).select("oid"))
        trees = below.where(F.col("mode") == MODE_TREE).select("oid")
    return reduce(DataFrame.union, out).distinct()


def unreachable(objects: DataFrame, alive: DataFrame) -> DataFrame:
    """Objects that nothing keeps alive, which a collection removes."""
    return objects.join(alive.select("oid"), "oid", "left_anti")


def by_priority(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """Each id from the source with the lowest number that has it. The minimum is taken before the shuffle."""
    all_ = reduce(DataFrame.unionByName, [df.select("oid", "type", "size", F.lit(p).alias("priority"), "source") for p, df in sources])
    best = all_.groupBy("oid").agg(F.min(F.struct("priority", "source", "type", "size")).alias("best"))
    return best.select("oid", "best.type", "best.size", "best.source", "best.priority")


def by_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """The object with the smallest id that starts with a prefix, and how many ids do: more than one is ambiguous."""
    hits = objects.where(F.col("oid").startswith(prefix))
    return hits.agg(F.min("oid").alias("oid"), F.count_distinct("oid").alias("matches"))


def existing(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(objects.select("oid"), "oid", "left_semi")


def missing(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(objects.select("oid"), "oid", "left_anti")


def stats(objects: DataFrame, *by: str) -> DataFrame:
    return objects.groupBy(*by).agg(F.count("*").alias("n_objects"), F.count_distinct("oid").alias("n_ids"), F.sum("size").alias("total_size"), F.max("size").alias("max_size"))


def filtered(objects: DataFrame, spec: str) -> DataFrame:
    return objects.where(filter_spec(spec))


def corrupt(objects: DataFrame) -> DataFrame:
    """Objects whose content does not hash to their id."""
    return objects.withColumn("actual", object_id(F.col("type"), F.col("data"))).where("oid <> actual")


def follow_replacements(wanted: DataFrame, replacements: DataFrame) -> DataFrame:
    """wanted with the id to read: that of its replacement if there is one."""
    return wanted.join(replacements.select("oid", F.col("target").alias("other")), "oid", "left").select(*wanted.columns, F.coalesce("other", "oid").alias("read_oid"))


def fanout(ids: DataFrame, key: Column | None = None) -> DataFrame:
    """256 rows: bucket of the first byte, ids in it, ids up to it. Counts are taken before the shuffle; the running sum sees
    256 rows."""
    from pyspark.sql.window import Window

    bucket = (key if key is not None else F.conv(F.substring("oid", 1, 2), 16, 10)).cast("int")
    counts = ids.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    all_ = ids.sparkSession.range(256).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bucket"))
    return all_.select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), running.cast("bigint").alias("cumulative"))


def positions(ids: DataFrame, digits: int = 4) -> DataFrame:
    """ids (oid, ...) with position, the rank by oid from 0, without one sort over everything.

    Ids are digests, so their leading digits deal them out evenly: ranks are counted inside a bucket, and the buckets' sizes,
    at most 16 ** digits rows, are summed up first.
    """
    from pyspark.sql.window import Window

    cut = ids.withColumn("bucket__", F.substring("oid", 1, digits))
    sizes = cut.groupBy("bucket__").agg(F.count("*").alias("n"))
    top = Window.partitionBy(F.substring("bucket__", 1, 2)).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy(F.substring("bucket__", 1, 2).alias("top")).agg(F.sum("n").alias("n"))
    before = groups.select("top", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n").over(top), F.lit(0))).withColumn("top", F.substring("bucket__", 1, 2)).join(F.broadcast(before), "top").select("bucket__", (F.col("inner") + F.col("base")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket__").orderBy("oid")) - 1
    return cut.withColumn("rank__", rank).join(starts, "bucket__").withColumn("position", (F.col("start") + F.col("rank__")).cast("bigint")).drop("bucket__", "rank__", "start")
