"""Packs, staging files and multi-pack indexes in their binary forms, one file a row of Spark's binary reader."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions.binary import delta_apply
from cairnspark.functions.hashing import object_id
from cairnspark.model import OBJECT_TYPES, OFFSET_DELTA, REFERENCE_DELTA
from cairnspark.scratch import cut
from cairnspark.sources.files import HELD, binary_files, column, hex_column, pack_indexes, records, tasks

# Signatures, versions and field layouts of the formats.
STAGING = struct.Struct(">4sII")  # DIRC, version, entries
STAT = struct.Struct(">10I")  # changed s, ns; modified s, ns; device, inode, mode, user, group, size
TRAILER, NO_PARENT = 32, 0xFFFFFFFF
FEED = 1 << 16
AT_ONCE = 500  # entries of a pack that are handed on together
RANGE = 16 << 20  # bytes of a pack that a task reads together


def inflate_at(data: memoryview, at: int) -> tuple[bytes, int]:
    """The zlib stream that begins at a place, and the place behind it."""
    stream, out = zlib.decompressobj(), []
    while not stream.eof:
        part = data[at : at + FEED]
        if not part:
            raise ValueError("a compressed object breaks off")
        out.append(stream.decompress(part))
        at += len(part) - len(stream.unused_data)
    return b"".join(out), at


Entry = tuple[int, int, str, int | None, str | None, bytes]
ENTRY = "nth int, offset bigint, kind string, base_offset bigint, base_oid string, payload binary"
OBJECT = "nth int, offset bigint, type string, size bigint, data binary, oid string"


def pack_entry(data: memoryview, start: int, nth: int = 0, shift: int = 0) -> tuple[Entry, int]:
    """(nth, offset, kind, base_offset, base_oid, payload) of the entry at a place, and the place behind it. shift is what lies before
    the data in its pack. A delta's payload is the delta; one of its bases is not null."""
    at, byte = start, data[start]
    kind = byte >> 4 & 7
    while data[at] & 0x80:  # the size, which the stream tells too
        at += 1
    at += 1
    base_offset = base_oid = None
    if kind == OFFSET_DELTA:
        back = data[at] & 0x7F
        while data[at] & 0x80:
            at += 1
            back = back + 1 << 7 | data[at] & 0x7F
        at += 1
        base_offset = start + shift - back
    elif kind == REFERENCE_DELTA:
        base_oid = bytes(data[at : at + 32]).hex()
        at += 32
    payload, at = inflate_at(data, at)
    return (nth, start + shift, dict(OBJECT_TYPES)[kind], base_offset, base_oid, payload), at


class Feed:
    """Bytes that are taken one after the other from pieces, of which one is held at a time; at counts them."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left, self.at = pieces, memoryview(b""), 0

    def piece(self) -> memoryview:
        while not len(self.left):
            if (found := next(self.pieces, None)) is None:
                raise ValueError("a pack breaks off")
            self.left = memoryview(found)
        return self.left

    def take(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            part = self.piece()[: n - len(out)]
            out += part
            self.left = self.left[len(part) :]
        self.at += n
        return bytes(out)

    def inflate(self) -> bytes:
        stream, out = zlib.decompressobj(), []
        while not stream.eof:
            part = self.piece()
            out.append(stream.decompress(part))
            used = len(part) - len(stream.unused_data)
            self.left, self.at = part[used:], self.at + used
        return b"".join(out)

    def rest(self) -> Iterator[bytes]:
        yield bytes(self.left)
        yield from self.pieces


def pack_entries(pieces: bytes | Iterator[bytes]) -> Iterator[Entry]:
    """The entries of a pack, whole or in pieces, one after the other; none if there is not a byte."""
    pieces = iter([pieces]) if isinstance(pieces, bytes) else pieces
    if (first := next((x for x in pieces if len(x)), None)) is None:
        return
    feed = Feed(chain([first], pieces))
    head = feed.take(12)
    if head[:8] != b"PACK\0\0\0\2":
        raise ValueError("no pack of version 2")
    for nth in range(int.from_bytes(head[8:])):
        start, byte = feed.at, feed.take(1)[0]
        kind = byte >> 4 & 7
        while byte & 0x80:  # the size, which the stream tells too
            byte = feed.take(1)[0]
        base_offset = base_oid = None
        if kind == OFFSET_DELTA:
            byte = feed.take(1)[0]
            back = byte & 0x7F
            while byte & 0x80:
                byte = feed.take(1)[0]
                back = back + 1 << 7 | byte & 0x7F
            base_offset = start - back
        elif kind == REFERENCE_DELTA:
            base_oid = feed.take(32).hex()
        yield nth, start, dict(OBJECT_TYPES)[kind], base_offset, base_oid, feed.inflate()


def behind_header(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What comes after the first empty line."""
    last = b""
    for piece in pieces:
        _, found, rest = (last + piece).partition(b"\n\n")
        if found:
            yield rest
            yield from pieces
        last = piece[-1:]


def pack_band(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pack in a captured response, line after line: what bands() gives as a whole."""
    feed = Feed(pieces)
    while True:
        try:
            if (head := feed.take(4)) == b"PACK":
                break
            line = feed.take(max(int(head, 16), 4) - 4)
        except ValueError:  # no line, or one that breaks off
            return
        if line[:4] == b"PACK":
            yield line
        elif line[:1] == b"\1":
            yield line[1:]
    yield head
    yield from feed.rest()


def objects_of(entries: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """entries (file, ENTRY) to file, OBJECT, with deltas resolved by joins: those of whole objects first, then those of the objects
    that this gives, and so on; a round for each link of the longest chain.

    Bases are looked up in the same file, by place or by id, and in external (oid, type, data). A delta whose base is nowhere has
    neither data nor id.
    """
    entries = cut(entries, "entries")
    whole = entries.where("base_offset is null and base_oid is null").select("file", "nth", "offset", F.col("kind").alias("type"), F.octet_length("payload").cast("bigint").alias("size"), F.col("payload").alias("data"))
    found = cut(whole.withColumn("oid", object_id(F.col("type"), F.col("data"))), "objects")
    done, left = [found], entries.where("base_offset is not null or base_oid is not null")
    if external is not None:
        mine = left.where("base_oid is not null").join(found.select("file", F.col("oid").alias("base_oid")), ["file", "base_oid"], "left_anti")
        outside = mine.join(external.select(F.col("oid").alias("base_oid"), F.col("type").alias("base_type"), F.col("data").alias("base")), "base_oid")
        done.append(cut(_applied(outside), "objects"))
        found = found.unionByName(done[-1])
    while not left.isEmpty():
        base = found.select("file", F.col("offset").alias("base_offset"), F.col("oid").alias("base_oid"), F.col("type").alias("base_type"), F.col("data").alias("base"))
        met = [left.where(f"{key} is not null").join(base.drop(other), ["file", key]) for key, other in (("base_offset", "base_oid"), ("base_oid", "base_offset"))]
        found = cut(_applied(met[0].unionByName(met[1], allowMissingColumns=True)).dropDuplicates(["file", "offset"]), "objects")
        left = cut(left.join(reduce(DataFrame.unionByName, [*done, found]).select("file", "offset"), ["file", "offset"], "left_anti"), "entries")
        if found.isEmpty():
            break
        done.append(found)
    none = lambda c: F.lit(None).cast(c)
    done.append(left.select("file", "nth", "offset", F.col("kind").alias("type"), none("bigint").alias("size"), none("binary").alias("data"), none("string").alias("oid")))
    return reduce(DataFrame.unionByName, done)


def _applied(rows: DataFrame) -> DataFrame:
    """rows (file, nth, offset, payload, base_type, base) as objects."""
    new = rows.select("file", "nth", "offset", F.col("base_type").alias("type"), delta_apply("base", "payload").alias("data"))
    return new.select("file", "nth", "offset", "type", F.octet_length("data").cast("bigint").alias("size"), "data", object_id(F.col("type"), F.col("data")).alias("oid"))


def staged(content: bytes, width: int = 32) -> list[tuple]:
    """(path, stage, oid, mode, size, mtime) of a staging file of version 2; entries are padded to eight bytes."""
    magic, version, count = STAGING.unpack_from(content)
    if magic != b"DIRC" or version != 2:
        raise ValueError("no staging file of version 2")
    rows, at = [], STAGING.size
    for _ in range(count):
        stat = STAT.unpack_from(content, at)
        name = at + STAT.size + width + 2
        flags = int.from_bytes(content[name - 2 : name])
        end = content.index(b"\0", name)
        rows.append((content[name:end].decode(), flags >> 12 & 3, content[at + STAT.size : name - 2].hex(), stat[6], stat[9], stat[2]))
        at += -(-(end + 1 - at) // 8) * 8
    return rows


def _read(spark: SparkSession, root: str, glob: str, pattern: str, rows, schema: str) -> DataFrame:
    named = binary_files(spark, root, glob).select(F.regexp_extract("path", pattern, 1).alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                out = rows(bytes(content))
                out.insert(0, "file", file)
                yield out

    return named.mapInPandas(run, f"file string, {schema}")


def _frame(file: str, entries: list[Entry]) -> pd.DataFrame:
    out = pd.DataFrame(entries, columns=["nth", "offset", "kind", "base_offset", "base_oid", "payload"]).astype({"nth": "int32", "offset": "int64", "base_offset": "Int64"})
    out.insert(0, "file", file)
    return out


def _entries(spark: SparkSession, root: str, glob: str, pattern: str, find: Callable[[Iterator[bytes]], Iterator[bytes]]) -> DataFrame:
    """Entries of the packs that find() takes out of files, which are read piece by piece; a few MB of entries are in memory at a time."""
    named = binary_files(spark, root, glob).select("path", F.regexp_extract("path", pattern, 1).alias("file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, file in zip(batch["path"], batch["file"], strict=True):
                store, plain = fs.FileSystem.from_uri(path)
                with store.open_input_stream(plain) as opened:
                    part, size = [], 0
                    for entry in pack_entries(find(iter(lambda: opened.read(FEED), b""))):
                        part.append(entry)
                        size += len(entry[-1])
                        if len(part) == AT_ONCE or size >= HELD:
                            yield _frame(file, part)
                            part, size = [], 0
                    if part:
                        yield _frame(file, part)

    return named.repartition(tasks(spark), "path").mapInPandas(run, f"file string, {ENTRY}")


def packs(spark: SparkSession, root: str, external: DataFrame | None = None) -> DataFrame:
    """pack, OBJECT of all *.pack files. A pack is one task, as an entry's end is known only once it is read;
    indexed_packs() shares it out."""
    return objects_of(_entries(spark, root, "*.pack", r"/([^/]+)\.pack$", iter), external).withColumnRenamed("file", "pack")


def indexed_packs(spark: SparkSession, root: str, external: DataFrame | None = None) -> DataFrame:
    """pack, OBJECT of all packs with an index beside them, read by the ranges that the offsets give: a pack of any size is shared
    out among tasks, and nth counts in the order of offsets within a range."""
    files = binary_files(spark, root, "*.pack").select("path", F.regexp_extract("path", r"/([^/]+)\.pack$", 1).alias("pack"), "length")
    index = pack_indexes(spark, root).select("pack", "offset", F.floor(F.col("offset") / RANGE).alias("range"))
    inside = F.lead("offset").over(Window.partitionBy("pack", "range").orderBy("offset"))
    first = index.groupBy("pack", "range").agg(F.min("offset").alias("first"))
    after = first.select("pack", "range", F.lead("first").over(Window.partitionBy("pack").orderBy("range")).alias("after"))
    rows = index.withColumn("inner", inside).join(after, ["pack", "range"]).join(files, "pack")
    rows = rows.select("path", "pack", "range", "offset", F.coalesce("inner", "after", F.col("length") - TRAILER).alias("end"))
    dealt = rows.repartition("pack", "range").sortWithinPartitions("pack", "range", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, path = None, None
        for batch in batches:
            for name, part in batch.groupby("path", sort=False):
                if name != path:
                    store, plain = fs.FileSystem.from_uri(name)
                    opened, path = store.open_input_file(plain), name
                entries = []
                for nth, (start, end) in enumerate(zip(part["offset"], part["end"], strict=True)):
                    opened.seek(start)
                    entries.append(pack_entry(memoryview(opened.read(end - start)), 0, nth, start)[0])
                yield _frame(part["pack"].iloc[0], entries)

    return objects_of(dealt.mapInPandas(run, f"file string, {ENTRY}"), external).withColumnRenamed("file", "pack")


def responses(spark: SparkSession, root: str, glob: str = "*.response", external: DataFrame | None = None) -> DataFrame:
    """file, OBJECT of the packs in captured responses; one without a pack gives no rows."""
    return objects_of(_entries(spark, root, glob, "/([^/]+)$", pack_band), external)


def bundles(spark: SparkSession, root: str, external: DataFrame | None = None) -> DataFrame:
    """bundle, OBJECT of the packs behind the headers of all *.bundle files."""
    entries = _entries(spark, root, "*.bundle", r"/([^/]+)\.bundle$", behind_header)
    return objects_of(entries, external).withColumnRenamed("file", "bundle")


def commit_graphs(spark: SparkSession, root: str, glob: str = "commit-graph") -> DataFrame:
    """file, position, oid, parent1, parent2, generation, commit_time of all commit-graph files below root; a parent of all ones is null."""
    ids = 8 + 1024
    data = [("generation", ">u4"), ("commit_time", ">u8"), ("parent1", ">u4"), ("parent2", ">u4")]

    def layout(opened: fs.NativeFile) -> tuple:
        head = opened.read_at(ids, 0)
        if head[:4] != b"CGPH":
            raise ValueError("no commit graph")
        return int.from_bytes(head[-4:]), ()

    def read(opened: fs.NativeFile, n: int, first: int, some: int) -> pd.DataFrame:
        row = column(opened, ids + 32 * n, first, some, data)
        parent = lambda c: pd.Series(row[c].astype(np.int64)).where(row[c] != NO_PARENT).astype("Int64")
        return pd.DataFrame({"position": np.arange(first, first + some), "oid": hex_column(opened, ids, first, some, 32), "parent1": parent("parent1"), "parent2": parent("parent2"), "generation": row["generation"].astype(np.int32), "commit_time": row["commit_time"].astype(np.int64)})

    return records(spark, root, glob, "/([^/]+)$", layout, read, "position bigint, oid string, parent1 bigint, parent2 bigint, generation int, commit_time bigint")


def staging_files(spark: SparkSession, root: str, glob: str = "index", width: int = 32) -> DataFrame:
    """file, path, stage, oid, mode, size, mtime of all staging files below root; width: the bytes of an id."""
    frame = lambda content: pd.DataFrame(staged(content, width), columns=["path", "stage", "oid", "mode", "size", "mtime"])
    return _read(spark, root, glob, "([^/]+/[^/]+)$", frame, "path string, stage int, oid string, mode int, size bigint, mtime bigint")


def multi_packs(spark: SparkSession, root: str, width: int = 32) -> DataFrame:
    """file, oid, pack (its number), offset of all *.midx files; the columns of a file stand one behind the other."""

    def layout(opened: fs.NativeFile) -> tuple:
        head = opened.read_at(12, 0)  # MIDX, version, packs
        if head[:8] != b"MIDX\0\0\0\1":
            raise ValueError("no multi-pack index of version 1")
        ids = 12 + 4 * int.from_bytes(head[8:]) + 1024
        return int.from_bytes(opened.read_at(4, ids - 4)), (ids,)

    def read(opened: fs.NativeFile, n: int, first: int, some: int, ids: int) -> pd.DataFrame:
        pack, offset = column(opened, ids + n * width, first, some, "u1"), column(opened, ids + n * (width + 1), first, some, ">u4")
        return pd.DataFrame({"oid": hex_column(opened, ids, first, some, width), "pack": pack.astype(np.int32), "offset": offset.astype(np.int64)})

    return records(spark, root, "*.midx", "/([^/]+)$", layout, read, "oid string, pack int, offset bigint")
