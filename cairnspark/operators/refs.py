"""References: current values, changes, and the log of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.model import NO_OID
from cairnspark.operators.graph import ancestors_at
from cairnspark.scratch import cut


def full_name(name: Column) -> Column:
    """HEAD and refs/... stay; anything else is a branch."""
    return F.when((name == "HEAD") | name.startswith("refs/"), name).otherwise(F.concat(F.lit("refs/heads/"), name))


def listing(files: DataFrame, packed: DataFrame, pattern: str | None = None) -> DataFrame:
    """Names of both sources, each once, files before packed ones; a pattern must occur in the name."""
    all_ = files.select("name", "oid", F.lit(0).alias("rank")).unionByName(packed.select("name", "oid", F.lit(1).alias("rank")))
    if pattern:
        all_ = all_.where(F.col("name").contains(pattern))
    return all_.groupBy("name").agg(F.min_by("oid", "rank").alias("oid"))


def resolve(refs: DataFrame, most: int = 8) -> DataFrame:
    """name, oid after following symbolic targets at most `most` times; null if that leads nowhere. Only refs that still have a
    target go into the next round."""
    step = cut(refs.select(F.col("name").alias("at"), F.col("oid").alias("found"), F.col("target").alias("next")), "refs")
    ends = lambda rows: rows.where("found is not null or next is null").select("name", F.col("found").alias("oid"))
    now = step.withColumnRenamed("at", "name")
    done = [ends(now)]
    for _ in range(most):
        going = now.where("found is null and next is not null").select("name", F.col("next").alias("at"))
        if going.isEmpty():
            break
        now = cut(going.join(step, "at", "left").select("name", "found", "next"), "refs")
        done.append(ends(now))
    else:
        done.append(now.where("found is null and next is not null").select("name", "found"))
    return reduce(DataFrame.unionByName, [d.toDF("name", "oid") for d in done])


def rev_parse(specs: DataFrame, refs: DataFrame, edges: DataFrame, width: int = 64) -> DataFrame:
    """specs (spec) to spec, oid: a name with any number of ~N, ^ and ^N behind it; null if there is no such commit.

    A name is, in this order, HEAD, a whole id, a full ref, a branch or a tag. ~N goes back N first parents; ^N is the Nth
    parent, ^ the first, ^0 the commit itself. Names are looked up by one join, whole ids by none; refs are what carries the forms of a
    name, as there are fewer of them. Steps of all specs are taken together.
    """
    short = F.regexp_extract("spec", r"^([^~^]+)", 1)
    rows = specs.select("spec").distinct()
    full = (F.col("name") == "HEAD") | F.col("name").startswith("refs/")
    behind = lambda prefix, rank: F.when(F.col("name").startswith(prefix), F.struct(F.substr("name", F.lit(len(prefix) + 1)).alias("known"), F.lit(rank).alias("rank")))
    own = F.array(F.when(full, F.struct(F.col("name").alias("known"), F.lit(0).alias("rank"))), behind("refs/heads/", 1), behind("refs/tags/", 2))
    names = resolve(refs).where("oid is not null").select("oid", F.explode(F.array_compact(own)).alias("n")).groupBy("n.known").agg(F.min_by("oid", "n.rank").alias("by_name"))
    is_whole = F.coalesce(short.rlike(f"^[0-9a-f]{{{width}}}$"), F.lit(False))
    steps = F.expr(r"regexp_extract_all(substr(spec, length(name) + 1), '([~^][0-9]*)', 1)").alias("steps")
    whole = rows.where(is_whole).withColumn("by_name", short)
    named = rows.where(~is_whole).join(names, short == F.col("known"), "left").select("spec", "by_name")
    at = whole.union(named).withColumn("name", short).select("spec", F.col("by_name").alias("oid"), steps)
    at = cut(at, "specs")
    for k in range(at.agg(F.max(F.size("steps"))).first()[0] or 0):
        step = F.get("steps", F.lit(k))
        n = F.when(F.length(step) > 1, F.substr(step, F.lit(2)).cast("int")).otherwise(1)
        now = at.select("spec", "oid", "steps", F.substring(step, 1, 1).alias("kind"), n.alias("n"))
        back = ancestors_at(now.where("kind = '~' and oid is not null").select(F.col("spec").alias("key"), F.col("oid").alias("node"), "n"), edges).select(F.col("key").alias("spec"), F.col("oid").alias("moved"))
        up = now.where("kind = '^' and n > 0").join(edges, (F.col("oid") == F.col("child")) & (F.col("n") == F.col("nth"))).select("spec", F.col("parent").alias("moved"))
        stays = F.col("kind").isNull() | (F.col("n") == 0)
        at = cut(now.join(back.union(up), "spec", "left").select("spec", F.when(stays, F.col("oid")).otherwise(F.col("moved")).alias("oid"), "steps"), "specs")
    return at.select("spec", "oid")


def upsert(refs: DataFrame, changes: DataFrame, force: bool = True) -> DataFrame:
    """changes (name, oid, ts) over refs (name, oid): the last change of a name wins; without force only new names are taken."""
    last = changes.groupBy("name").agg(F.max_by("oid", "ts").alias("new_oid"))
    rows = refs.select("name", "oid").join(last, "name", "full_outer")
    order = ("new_oid", "oid") if force else ("oid", "new_oid")
    return rows.select("name", F.coalesce(*order).alias("oid"))


def remove(refs: DataFrame, names: DataFrame) -> DataFrame:
    return refs.join(names.select("name"), "name", "left_anti")


def replacements(refs: DataFrame) -> DataFrame:
    """(oid, target) of refs/replace/<oid>."""
    prefix = "refs/replace/"
    return refs.where(F.col("name").startswith(prefix)).select(F.substr("name", F.lit(len(prefix) + 1)).alias("oid"), F.col("oid").alias("target"))


def reflog(changes: DataFrame) -> DataFrame:
    """changes (ref, ts, oid, message) as log rows: the id before, zeros at first, and the id after.

    Changes are ordered inside a day, so that a busy ref is not in one task; the first of a day follows the last of the day
    before, of which there is one a ref and day.
    """
    cut = changes.withColumn("day", F.to_date("ts"))
    inside = F.lag("oid").over(Window.partitionBy("ref", "day").orderBy("ts", "oid"))
    last = cut.groupBy("ref", "day").agg(F.max_by("oid", F.struct("ts", "oid")).alias("last"))
    earlier = last.select("ref", "day", F.lag("last").over(Window.partitionBy("ref").orderBy("day")).alias("earlier"))
    rows = cut.withColumn("before", inside).join(earlier, ["ref", "day"])
    return rows.select("ref", F.coalesce("before", "earlier", F.lit(NO_OID)).alias("old_oid"), F.col("oid").alias("new_oid"), "ts", "message")


def reflog_line(old: Column, new: Column, signature: Column, message: Column) -> Column:
    return F.concat(F.coalesce(old, F.lit(NO_OID)), F.lit(" "), F.coalesce(new, F.lit(NO_OID)), F.lit(" "), signature, F.lit("\t"), F.coalesce(message, F.lit("update")))
