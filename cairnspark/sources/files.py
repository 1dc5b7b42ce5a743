"""Repository files as tables: loose objects, references, pack indexes, bundles, submodule and other INI texts."""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions.binary import deflate
from cairnspark.functions.codec import BUNDLE_TITLE, bundle_ref
from cairnspark.functions.hashing import header, object_id
from cairnspark.scratch import cut

# Format of a pack index.
IDX_MAGIC, IDX_VERSION, FANOUT_BYTES, TRAILER_BYTES = b"\xfftOc", 2, 1024, 64
LARGE_OFFSET = 1 << 31  # from here on, an offset is a place in the table of 64-bit offsets


LISTED, HELD = 1000, 8 << 20  # files, and bytes of them, that are handed on together
BUFFER = 1 << 16  # bytes of a header that are read together

# Directories that adding a directory passes over.
PASSED_OVER = (".git", "build", "build-linux")


def binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def tasks(spark: SparkSession) -> int:
    """For rows that stand for more than they hold: given as a number, it is not cut down by AQE, which goes by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) of all files that Spark's readers would take, listed by tasks, a level of directories at a time: the driver sees
    no names, however many files there are."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch["path"]:
                above = f"{base.rstrip('/')}/{folder}".rstrip("/")
                if isinstance(store, fs.LocalFileSystem):
                    found = ((e.name, e.is_dir()) for e in os.scandir(above))
                else:
                    found = ((e.base_name, e.type == fs.FileType.Directory) for e in store.get_file_info(fs.FileSelector(above)))
                named = ((f"{folder}/{name}".lstrip("/"), is_folder) for name, is_folder in found if not (name[0] == "." or name[0] == "_" and "=" not in name))
                while part := list(islice(named, LISTED)):
                    yield pd.DataFrame(part, columns=["path", "is_folder"])

    level, files = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        rows = cut(level.repartition(tasks(spark), "path").mapInPandas(look, "path string, is_folder boolean"), "listing")
        files.append(rows.where("not is_folder").select("path"))
        level = rows.where("is_folder").select("path")
    return reduce(DataFrame.union, files)


def contents(paths: DataFrame, root: str) -> DataFrame:
    """paths (path, below root) with content, a few MB of it in memory at a time. Many small files are what this is for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as opened:
                    rows.append((path, opened.read()))
                size += len(rows[-1][1])
                if size >= HELD or len(rows) == LISTED:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["path", "content"])

    return paths.select("path").repartition(tasks(paths.sparkSession), "path").mapInPandas(read, "path string, content binary")


def working_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size and data of the files of a working tree, without those in PASSED_OVER."""
    hidden = rf"(^|/)({'|'.join(map(re.escape, PASSED_OVER))})/"
    files = contents(listing(spark, root).where(~F.col("path").rlike(hidden)), root)
    return files.select("path", F.octet_length("content").cast("bigint").alias("size"), F.col("content").alias("data"))


def loose_objects(spark: SparkSession, root: str) -> DataFrame:
    """oid, type, size, data of the files `xx/yyyy...` below root; other names are passed over."""
    pattern = r"/([0-9a-f]{2})/([0-9a-f]{38,126})$"
    files = contents(listing(spark, root).where(F.concat(F.lit("/"), "path").rlike(pattern)), root).withColumn("path", F.concat(F.lit("/"), "path"))
    named = files.select(F.concat(F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)).alias("oid"), "content")

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for oid, content in zip(batch["oid"], batch["content"], strict=True):
                head, _, data = zlib.decompress(content).partition(b"\0")
                kind, _, size = head.decode().partition(" ")
                rows.append((oid, kind, int(size), data))
            yield pd.DataFrame(rows, columns=["oid", "type", "size", "data"])

    return named.mapInPandas(open_, "oid string, type string, size bigint, data binary")


def loose_payloads(objects: DataFrame) -> DataFrame:
    """objects (type, data) as oid, path and the compressed content of a loose file."""
    data = F.concat(header(F.col("type"), F.col("data")), F.col("data"))
    oid = object_id(F.col("type"), F.col("data"))
    return objects.select(oid.alias("oid"), F.concat(F.substring(oid, 1, 2), F.lit("/"), F.substr(oid, F.lit(3))).alias("path"), deflate(data).alias("content"))


def ref_files(spark: SparkSession, root: str) -> DataFrame:
    """name, oid, target of the files below root; a first line `ref: ` is symbolic."""
    path = F.concat(F.lit("/"), "path")
    files = contents(listing(spark, root), root).select(F.regexp_extract(path, r"/(refs/.*|HEAD)$", 1).alias("name"), F.substring_index(F.decode("content", "UTF-8"), "\n", 1).alias("line"))
    symbolic = F.col("line").startswith("ref: ")
    return files.where("name <> ''").select("name", F.when(~symbolic, F.trim("line")).alias("oid"), F.when(symbolic, F.trim(F.substr("line", F.lit(6)))).alias("target"))


def packed_refs(lines: DataFrame) -> DataFrame:
    """value (a line of packed-refs) to name, oid; comments and peeled tags are passed over."""
    return lines.where(F.col("value").rlike(r"^[0-9a-f]{40,128} \S")).select(F.substring_index("value", " ", -1).alias("name"), F.substring_index("value", " ", 1).alias("oid"))


RECORDS = 1 << 18  # records of an index file that are read together
SMALL = 1 << 16  # and that are in memory at once


def records(spark: SparkSession, root: str, glob: str, pattern: str, layout: Callable[[fs.NativeFile], tuple], read: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """file, and rows of files with records of fixed width in columns, read by ranges: a file of any size is shared out among tasks.

    layout() gives the number of records of an open file and what read(), which gives some records from a place on, must know.
    """
    named = binary_files(spark, root, glob).select("path", F.regexp_extract("path", pattern, 1).alias("file"))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, file in zip(batch["path"], batch["file"], strict=True):
                store, plain = fs.FileSystem.from_uri(path)
                with store.open_input_file(plain) as opened:
                    n, about = layout(opened)
                firsts = np.arange(0, n, RECORDS)
                yield pd.DataFrame({"path": path, "file": file, "first": firsts, "n": n, "about": [list(about)] * len(firsts)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, file, first, n, about in batch.itertuples(index=False, name=None):
                store, plain = fs.FileSystem.from_uri(path)
                with store.open_input_file(plain) as opened:
                    for at in range(first, min(first + RECORDS, n), SMALL):
                        out = read(opened, n, at, min(SMALL, n - at, first + RECORDS - at), *map(int, about))
                        out.insert(0, "file", file)
                        yield out

    dealt = named.mapInPandas(ranges, "path string, file string, first bigint, n bigint, about array<bigint>").repartition(tasks(spark), "path", "first")
    return dealt.mapInPandas(run, f"file string, {schema}")


def column(opened: fs.NativeFile, start: int, first: int, n: int, kind: str) -> np.ndarray:
    """n values of a column that begins at a place in a file, from one of them on."""
    width = np.dtype(kind).itemsize
    data = opened.read_at(n * width, start + first * width)
    if len(data) < n * width:
        raise ValueError("a file of records breaks off")
    return np.frombuffer(data, kind, n)


def hex_column(opened: fs.NativeFile, start: int, first: int, n: int, width: int) -> list[str]:
    raw = column(opened, start, first, n, f"V{width}").tobytes().hex()
    return [raw[i : i + 2 * width] for i in range(0, len(raw), 2 * width)]


def pack_indexes(spark: SparkSession, root: str) -> DataFrame:
    """pack, oid, crc32, offset of all *.idx files of version 2; the width of ids follows from a file's size."""
    at = 8 + FANOUT_BYTES

    def layout(opened: fs.NativeFile) -> tuple:
        size, content = opened.size(), opened.read_at(at, 0)
        if content[:4] != IDX_MAGIC or int.from_bytes(content[4:8]) != IDX_VERSION:
            raise ValueError(f"no pack index of version {IDX_VERSION}")
        n = int.from_bytes(content[at - 4 :])
        width = next(w for w in (32, 20, 48, 64) if at + n * (w + 8) <= size - 2 * min(w, TRAILER_BYTES) and (size - at - n * (w + 8) - 2 * w) % 8 == 0)
        return n, (width, size - 2 * min(width, TRAILER_BYTES))

    def read(opened: fs.NativeFile, n: int, first: int, some: int, width: int, end: int) -> pd.DataFrame:
        crc, offset, large = (at + n * w for w in (width, width + 4, width + 8))
        crcs, places = (column(opened, start, first, some, ">u4").astype(np.int64) for start in (crc, offset))
        far = np.flatnonzero(places >= LARGE_OFFSET)
        nth = places[far] - LARGE_OFFSET
        if len(nth) and nth.max() >= (end - large) // 8:
            raise ValueError("an offset lies beyond the table of large offsets")
        for lo in range(0, len(nth), SMALL):  # places in that table need not follow one another
            some_ = nth[lo : lo + SMALL]
            if some_.max() - some_.min() < 4 * SMALL:
                table = column(opened, large, int(some_.min()), int(some_.max() - some_.min()) + 1, ">u8")
                places[far[lo : lo + SMALL]] = table[some_ - some_.min()].astype(np.int64)
            else:
                places[far[lo : lo + SMALL]] = [int(column(opened, large, int(k), 1, ">u8")[0]) for k in some_]
        return pd.DataFrame({"oid": hex_column(opened, at, first, some, width), "crc32": crcs, "offset": places})

    rows = records(spark, root, "*.idx", r"/([^/]+)\.idx$", layout, read, "oid string, crc32 bigint, offset bigint")
    return rows.withColumnRenamed("file", "pack")


def bundle_refs(spark: SparkSession, root: str) -> DataFrame:
    """file, oid, name of the refs in the headers of all *.bundle files, which are read line by line up to the first empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        title = BUNDLE_TITLE.encode()
        for batch in batches:
            for path in batch["path"]:
                store, plain = fs.FileSystem.from_uri(path)
                with store.open_input_stream(plain) as opened, io.BufferedReader(opened, BUFFER) as reader:
                    if reader.read(len(title)) != title:
                        continue
                    reader.readline()
                    lines = takewhile(lambda x: x != b"\n", reader)
                    while part := list(islice(lines, LISTED)):
                        yield pd.DataFrame({"file": path, "line": [x.rstrip(b"\n").decode("utf-8", "replace") for x in part]})

    lines = binary_files(spark, root, "*.bundle").select("path").repartition(tasks(spark), "path").mapInPandas(run, "file string, line string")
    return lines.select("file", bundle_ref(F.col("line")).alias("r")).where("r is not null").select("file", "r.oid", "r.name")


def ini(texts: DataFrame) -> DataFrame:
    """texts (file, text) to file, section, subsection, key, value, with blanks and carriage returns trimmed.

    A key belongs to the last section line before it.
    """
    blanks = F.lit(" \t\r")
    lines = texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).withColumn("line", F.btrim("line", blanks))
    head = r'^\[\s*([^\s"\]]+)(?:\s+"([^"]*)")?\s*\]$'
    section = F.when(F.col("line").rlike(head), F.struct(F.regexp_extract("line", head, 1).alias("section"), F.regexp_extract("line", head, 2).alias("subsection")))
    filled = F.last(section, True).over(Window.partitionBy("file").orderBy("at"))
    rows = lines.withColumn("s", filled).where(F.col("line").rlike(r"^[^#;\[=][^=]*="))
    return rows.select("file", "s.section", "s.subsection", F.btrim(F.substring_index("line", "=", 1), blanks).alias("key"), F.btrim(F.regexp_extract("line", "=(.*)$", 1), blanks).alias("value"))


def submodules(texts: DataFrame) -> DataFrame:
    """name, path, url, branch of the submodule sections of INI texts."""
    rows = ini(texts).where("section = 'submodule'")
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)
    return rows.groupBy("file", F.col("subsection").alias("name")).agg(value("path"), value("url"), value("branch"))


def remotes(texts: DataFrame) -> DataFrame:
    """name, url of the remote sections."""
    return ini(texts).where("section = 'remote' and key = 'url'").select(F.col("subsection").alias("name"), F.col("value").alias("url"))
