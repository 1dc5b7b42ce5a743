"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cairnspark-")
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: plans do not grow with loops, and lost executors cost nothing.

    The table stays until drop() or until the owner of the folder clears it, as lazily read results depend on it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(kept: DataFrame) -> None:
    """Delete a table of cut() that nothing reads any more."""
    jvm, spark = kept.sparkSession._jvm, kept.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(kept._scratch)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
