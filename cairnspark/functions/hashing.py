"""Digests and object ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.model import ERRORS, HASH_ALGORITHMS, OBJECT_TYPES


def header(type_: Column, data: Column) -> Column:
    """What stands before the payload when an object is hashed: its type, its size in decimal, and a zero byte."""
    return F.concat(F.encode(F.concat(type_, F.lit(" "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")))


def object_id(type_: Column, data: Column) -> Column:
    """SHA-256 over header and payload, as lower-case hex."""
    return F.sha2(F.concat(header(type_, data), data), 256)


def digest(algorithm: str, data: Column) -> Column:
    """Lower-case hex digest by an algorithm of HASH_ALGORITHMS. Those of Spark stay in the JVM, SHA-3 and SHAKE run in Arrow."""
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha256", "sha384"):
        return F.sha2(data, int(algorithm[3:]))
    if algorithm not in {a[1] for a in HASH_ALGORITHMS}:
        raise ValueError(f"no hash algorithm {algorithm}")
    length = next(a[2] for a in HASH_ALGORITHMS if a[1] == algorithm)
    make = getattr(hashlib, algorithm.replace("-", "_") if algorithm.startswith("sha3") else algorithm.replace("shake", "shake_"))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        of = (lambda b: make(b).hexdigest(length)) if algorithm.startswith("shake") else (lambda b: make(b).hexdigest())
        return values.map(lambda b: None if b is None else of(bytes(b)))

    return run(data)


def register(spark: SparkSession, name: str, function) -> None:
    """Makes a digest of one's own, a Python function from bytes to hex, callable from SQL under a name; it runs in Arrow."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else function(bytes(b)))

    spark.udf.register(name, run)


def algorithm_of_hex(oid: Column) -> Column:
    """The algorithm that the width of an id stands for; null for other widths. SHA3 ids of the same width are not told apart."""
    return F.when(F.length(oid) == 40, "sha1").when(F.length(oid) == 64, "sha256").when(F.length(oid) == 96, "sha384").when(F.length(oid) == 128, "sha3-512")


def type_code(name: Column) -> Column:
    """Number of an object type; unknown names count as blobs."""
    known = F.create_map(*[F.lit(x) for code, label in OBJECT_TYPES[:4] for x in (label, code)])
    return F.coalesce(known[name], F.lit(1))


def hash_algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HASH_ALGORITHMS, "algo int, name string, digest_len int, block_size int")


def object_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBJECT_TYPES, "code int, type string")


def error_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code int, text string")
