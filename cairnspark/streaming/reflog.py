"""Streams of reference changes, of objects and of calls to remotes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.model import BUDGET_A_MINUTE, FAILURES_TO_OPEN, MOST_QUEUED, MOST_RUNNING, SHED_PERCENT
from cairnspark.operators.objects import write_new
from cairnspark.operators.packs import running_sum


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet below folder, and reads the result.

    complete replaces the table at every batch; append adds files. Offsets and state are kept beside it, so that a run that is
    broken off goes on where it was.
    """
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{path}/out")
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def latest_refs(changes: DataFrame) -> DataFrame:
    """changes (ref, ts, oid) as a stream to the last id and the number of changes of each ref."""
    return changes.groupBy("ref").agg(F.max_by("oid", "ts").alias("oid"), F.count("*").alias("n_changes"))


def new_objects(objects: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of objects (oid, ...) into a table below folder that has each id once, and reads it.

    The table itself says what is known, so the stream keeps no state that grows with the ids: a batch is deduplicated, and what
    earlier batches have written is taken out by an anti join. Each batch has a folder of its own, so that one that is repeated
    after a failure takes the place of its first attempt.
    """
    spark, path, schema = objects.sparkSession, f"{folder}/objects-{uuid.uuid4().hex}", objects.schema

    def write(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.schema("oid string, batch bigint").parquet(f"{path}/out").where(F.col("batch") < number) if number else batch.limit(0)
        write_new(known, batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = objects.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").select(*schema.names)


def call_windows(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """calls (remote, ts, ok), a table or a stream, to one row for each remote and minute: calls, failures, calls over the budget of a
    minute (over_budget), and whether there were enough failures to stop calling (opens).

    Counts are taken before the shuffle, so a busy remote is no hot key; a stream gives a minute out once the delay is over.
    """
    rows = calls.withWatermark("ts", delay) if calls.isStreaming else calls
    counted = rows.groupBy("remote", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n_calls"), F.count_if(~F.col("ok")).alias("n_failed"))
    over = F.greatest(F.col("n_calls") - BUDGET_A_MINUTE, F.lit(0))
    return counted.select("remote", F.col("w.start").alias("minute"), "n_calls", "n_failed", over.alias("over_budget"), (F.col("n_failed") >= FAILURES_TO_OPEN).alias("opens"))


def running_load(work: DataFrame) -> DataFrame:
    """work (remote, id, ts, starts) with running, the pieces of work begun and not ended after this row, and shed: whether a gate of
    the usual size would refuse one more.

    Sums run inside an hour; hours of a remote are added up on their own, so no task meets a whole remote.
    """
    change = F.when(F.col("starts"), 1).otherwise(-1)
    summed = running_sum(work.select("remote", "id", "ts", "starts"), "remote", F.date_trunc("hour", "ts"), ["ts", "id"], change, "before")
    after = F.col("before") + change
    return summed.select("remote", "id", "ts", after.alias("running"), (after >= (MOST_RUNNING + MOST_QUEUED) * SHED_PERCENT // 100).alias("shed"))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files. A stream takes a single file only as a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
