"""What one store has and another lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.model import NO_OID
from cairnspark.operators.graph import fast_forward
from cairnspark.operators.objects import write_new


def lacking(source: DataFrame, sink: DataFrame) -> DataFrame:
    """Objects to copy from source to sink, each id once."""
    return write_new(sink, source)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("oid"), "oid", "left_semi").select("oid").distinct()


def receive_commands(local: DataFrame, remote: DataFrame) -> DataFrame:
    """For each local branch: the remote's id, zeros if it has none, and the new id."""
    heads = local.where(F.col("name").startswith("refs/heads/")).select("name", F.col("oid").alias("new_oid"))
    return heads.join(remote.select("name", F.col("oid").alias("old")), "name", "left").select("name", F.coalesce("old", F.lit(NO_OID)).alias("old_oid"), "new_oid")


def fetch_refs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Refs after a fetch: the remote's branches over the local refs."""
    theirs = remote.where(F.col("name").startswith("refs/heads/")).select("name", F.col("oid").alias("new"))
    return local.select("name", "oid").join(theirs, "name", "full_outer").select("name", F.coalesce("new", "oid").alias("oid"))


def haves(local: DataFrame, most: int = 32) -> DataFrame:
    """The ids that a request names as held: the first ones in order."""
    return local.select("oid").distinct().orderBy("oid").limit(most)


def wants(local: DataFrame, remote_refs: DataFrame) -> DataFrame:
    """The ids that a request asks for: those of the remote's refs that the local store lacks, each once."""
    return remote_refs.select("oid").where("oid is not null").distinct().join(local.select("oid"), "oid", "left_anti")


def fetch(objects: DataFrame, refs: DataFrame, remote_objects: DataFrame, remote_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a fetch adds to the objects, and the refs after it."""
    return lacking(remote_objects, objects), fetch_refs(refs, remote_refs)


def push(objects: DataFrame, refs: DataFrame, remote_objects: DataFrame, remote_refs: DataFrame, edges: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """What a push adds to the remote's objects, and for each local branch the remote's ref after it: name, oid, accepted.

    Without force a branch is accepted if the remote does not have it or is behind it.
    """
    heads = refs.where(F.col("name").startswith("refs/heads/")).select("name", F.col("oid").alias("theirs"))
    old = F.when(F.col("old").cast("string") != NO_OID, F.col("old"))
    asked = heads.join(remote_refs.select("name", F.col("oid").alias("old")), "name", "left").select("name", old.alias("ours"), "theirs")
    if force:
        after = asked.select("name", F.col("theirs").alias("oid"), F.lit(True).alias("accepted"))
    else:
        moved = fast_forward(asked, edges)
        after = asked.select("name", "theirs").join(moved, "name").select("name", "oid", (F.col("merged") | (F.col("oid") == F.col("theirs"))).alias("accepted"))
    return lacking(objects, remote_objects), after
