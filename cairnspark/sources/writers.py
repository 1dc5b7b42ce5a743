"""Packs, bundles and index files as sinks.

A binary file here is a sequence of parts: rows (file, block, key, bytes) in the order of block and key. What the parts are is
worked out by joins and aggregations; tasks write ranges of them, and one task for each file joins these, without keeping any.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.functions.binary import multiplexed
from cairnspark.functions.codec import bundle_header
from cairnspark.functions.hashing import type_code
from cairnspark.model import REFERENCE_DELTA
from cairnspark.operators import packs
from cairnspark.scratch import cut
from cairnspark.sources.files import tasks

# Signatures and versions of the formats, in hex.
PACK, IDX, STAGING, MULTI, GRAPH = "5041434b00000002", "ff744f6300000002", "4449524300000002", "4d49445800000001", "4347504801010000"
NO_PARENT, LARGE_OFFSET = 0xFFFFFFFF, 1 << 31
PIECE = 8 << 20  # bytes that are copied together
PACKS_OF_A_MULTI = 256  # numbers of packs have one byte there


def number(value: Column, size: int) -> Column:
    """size bytes of a number that is not negative, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def raw(hex_: str) -> Column:
    return F.unhex(F.lit(hex_))


def segment(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as opened:
        while data := opened.read(PIECE):
            yield data


def put(store: fs.FileSystem, path: str, pieces: Iterator[bytes]) -> int:
    """Writes a file, which has a name of its own until it is whole: its size."""
    above, _, last = path.rpartition("/")
    store.create_dir(above, recursive=True)
    own, size = f"{above}/.{last}.{TaskContext.get().taskAttemptId()}", 0
    with store.open_output_stream(own) as out:
        for data in pieces:
            out.write(data)
            size += len(data)
    store.move(own, path)
    return size


def drop_segments(root: str, folder: str) -> None:
    store, base = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{base}/{folder}").type == fs.FileType.Directory:
        store.delete_dir(f"{base}/{folder}")


def write_parts(parts: DataFrame, root: str, seal: str = "sha256", sealed_from: int = 0, form: Callable[[Iterator[bytes]], Iterator[bytes]] = iter) -> DataFrame:
    """Writes each file of parts (file, block, key, bytes) below root: file, size, digest.

    The digest is SHA-256 over the blocks from sealed_from on; seal says what ends the file: that digest (sha256) or as many zero
    bytes (zeros), which have no digest. form() makes what is written of all this, piece by piece. Null bytes are left out. Rows are dealt out by ranges of file, block and key, and a task writes each of
    its ranges as a segment. Then a task for each file puts the segments one behind the other, a few MB at a time: rows of a file
    meet nowhere. Segments and files have names of their own until they are whole, so no attempt leaves half a file.
    """
    folder = f"segments-{uuid.uuid4().hex}"

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        task, nth, now, out, rows = TaskContext.get(), 0, None, None, []
        store.create_dir(f"{base}/{folder}", recursive=True)
        for batch in batches:
            for file, block, data in zip(batch["file"], batch["block"], batch["bytes"], strict=True):
                if (file, block) != now:
                    if out is not None:
                        out.close()
                    now, nth, name = (file, block), nth + 1, f"{folder}/{task.taskAttemptId()}-{nth}"
                    out = store.open_output_stream(f"{base}/{name}")
                    rows.append((file, block, task.partitionId(), name))
                if data is not None:
                    out.write(bytes(data))
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["file", "block", "part", "name"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        rows = (row for batch in batches for row in zip(batch["file"], batch["block"], batch["name"], strict=True))
        for file, pieces in groupby(rows, itemgetter(0)):
            digest = hashlib.sha256() if seal == "sha256" else None

            def body(pieces=pieces, digest=digest) -> Iterator[bytes]:
                for _, block, name in pieces:
                    for data in segment(store, f"{base}/{name}"):
                        if digest and block >= sealed_from:
                            digest.update(data)
                        yield data
                yield digest.digest() if digest else bytes(32)

            size = put(store, f"{base}/{file}", form(body()))
            yield pd.DataFrame({"file": [file], "size": [size], "digest": [digest and digest.hexdigest()]})

    dealt = parts.repartitionByRange("file", "block", "key").sortWithinPartitions("file", "block", "key").select("file", "block", "bytes")
    pieces = cut(dealt.mapInPandas(segments, "file string, block int, part int, name string"), "segments")
    ordered = pieces.repartition(tasks(parts.sparkSession), "file").sortWithinPartitions("file", "block", "part").select("file", "block", "name")
    written = cut(ordered.mapInPandas(join, "file string, size bigint, digest string"), "written")
    drop_segments(root, folder)
    return written


def _parts(rows: DataFrame, block: int, key, data: Column) -> DataFrame:
    key = F.unhex("oid") if key == "oid" else F.encode(F.lit("") if key is None else F.col(key), "UTF-8")
    return rows.select("file", F.lit(block).alias("block"), key.alias("key"), data.alias("bytes"))


def fanout_parts(ids: DataFrame, block: int) -> DataFrame:
    """The 256 running counts by first byte of the ids (file, oid) of each file."""
    counts = ids.groupBy("file", F.conv(F.substring("oid", 1, 2), 16, 10).cast("int").alias("first")).agg(F.count("*").alias("n"))
    lists = counts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("n"))  # 256 entries at most
    every = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.get(F.map_values(F.map_filter("n", lambda k, _: k == b)), F.lit(0)), F.lit(0)))
    running = F.aggregate(every, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    line = F.unhex(F.array_join(F.transform(F.slice(running, 2, 256), lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    return _parts(lists, block, None, line)


@F.pandas_udf(T.BinaryType())
def pack_entry(kind: pd.Series, data: pd.Series, base: pd.Series) -> pd.Series:
    """An object in a pack: type and size, the base's raw id where there is one, the zlib stream."""

    def one(code: int, data: bytes, base: str | None) -> bytes:
        n, out = len(data), bytearray()
        low, n = n & 15, n >> 4
        out.append(code << 4 | low | (0x80 if n else 0))
        while n:
            low, n = n & 0x7F, n >> 7
            out.append(low | (0x80 if n else 0))
        return bytes(out) + (bytes.fromhex(base) if base else b"") + zlib.compress(data)

    return pd.Series([one(c, bytes(d), b) for c, d, b in zip(kind, data, base, strict=True)], kind.index, object)


def by_prefix(objects: DataFrame, digits: int = 1) -> DataFrame:
    """objects with a pack for each, by the first digits of its id: 16 ** digits packs of about equal numbers."""
    return objects.withColumn("pack", F.concat(F.lit("pack-"), F.substring("oid", 1, digits)))


def _entries(objects: DataFrame) -> DataFrame:
    """objects (pack, oid, type, data; with base_oid, data is a delta to that object) to pack, oid, bytes."""
    base = F.col("base_oid") if "base_oid" in objects.columns else F.lit(None).cast("string")
    kind = F.when(base.isNotNull(), REFERENCE_DELTA).otherwise(type_code(F.col("type")))
    return objects.select("pack", "oid", pack_entry(kind, F.col("data"), base).alias("bytes"))


def _pack_index(entries: DataFrame, ahead: int) -> DataFrame:
    """pack, oid, crc32, offset of entries in the order of their ids, behind so many bytes."""
    sized = entries.select("pack", "oid", F.crc32("bytes").alias("crc32"), F.octet_length("bytes").alias("length"))
    placed = packs.running_sum(sized, "pack", F.substring("oid", 1, 3), ["oid"], F.col("length"), "before")
    return placed.select("pack", "oid", "crc32", (F.col("before") + ahead).alias("offset"))


def _pack_parts(entries: DataFrame, ending: str) -> DataFrame:
    named = entries.withColumn("file", F.concat("pack", F.lit(ending)))
    head = named.groupBy("file").agg(F.count("*").alias("n"))
    return _parts(head, 0, None, F.concat(raw(PACK), number(F.col("n"), 4))).union(_parts(named, 1, "oid", F.col("bytes")))


def write_packs(objects: DataFrame, root: str) -> DataFrame:
    """objects (pack, oid, type, data[, base_oid]), each id once a pack, as <pack>.pack and <pack>.idx: pack, oid, crc32, offset.

    Entries are compressed in parallel and lie in the order of ids; a file is put together by one task.
    """
    entries = cut(_entries(objects), "entries")
    written = write_parts(_pack_parts(entries, ".pack"), root)
    index = cut(_pack_index(entries, 12), "index")
    write_pack_indexes(index, written.select(F.substring_index("file", ".pack", 1).alias("pack"), "digest"), root)
    return index


def write_responses(objects: DataFrame, root: str) -> DataFrame:
    """objects as above as <pack>.response, the pack in lines of its channel: file, size, digest (the pack's). No pack is held or written whole."""
    return write_parts(_pack_parts(cut(_entries(objects), "entries"), ".response"), root, form=multiplexed)


def write_pack_indexes(index: DataFrame, digests: DataFrame, root: str, oid: Column | None = None) -> DataFrame:
    """index (pack, oid, crc32, offset) and digests (pack, digest) as <pack>.idx of version 2: file, size, digest. Offsets from 2 GiB on go
    to a table of their own, in the order of ids.

    Rows are dealt out once, by ranges of pack and id, and a task writes each column of each of its ranges as a segment. Places in
    the table count from a range's first large offset on; what lies before it is added where segments are put one behind the
    other. An index that holds what ids are made of takes their making as oid, and digests are not moved.
    """
    folder, id_ = f"segments-{uuid.uuid4().hex}", F.unhex(F.col("oid") if oid is None else oid)
    columns = range(4)  # ids, checksums, places, large offsets

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        task, made, outs = TaskContext.get(), [], []
        store.create_dir(f"{base}/{folder}", recursive=True)
        for batch in batches:
            if batch[["pack", "id"]].isna().any(axis=None):
                raise ValueError("an object without a pack or an id is in no index")
            for pack, part in batch.groupby("pack", sort=False):
                if not made or pack != made[-1]["pack"]:
                    for out in outs:
                        out.close()
                    made.append({"pack": pack, "part": task.partitionId(), "name": f"{folder}/{task.taskAttemptId()}-{len(made)}", "large": 0, "firsts": np.zeros(256, np.int64)})
                    outs = [store.open_output_stream(f"{base}/{made[-1]['name']}-{k}") for k in columns]
                ids, places = b"".join(part["id"]), part["offset"].to_numpy(np.int64)
                far = places >= LARGE_OFFSET
                nth = made[-1]["large"] + np.cumsum(far) - 1
                made[-1]["large"] += int(far.sum())
                made[-1]["firsts"] += np.bincount(np.frombuffer(ids, np.uint8).reshape(len(part), -1)[:, 0], minlength=256)
                arrays = part["crc32"].to_numpy(">u4"), np.where(far, LARGE_OFFSET + nth, places).astype(">u4"), places[far].astype(">u8")
                for out, data in zip(outs, [ids, *(x.tobytes() for x in arrays)], strict=True):
                    out.write(data)
        for out in outs:
            out.close()
        yield pd.DataFrame(made, columns=["pack", "part", "name", "large", "firsts"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        rows = (row for batch in batches for row in zip(*(batch[c] for c in ("pack", "name", "large", "firsts", "end")), strict=True))
        for pack, found in groupby(rows, itemgetter(0)):
            (*_, end), *pieces = found  # one for each task that had rows of the pack
            if end is None or any(x[-1] is not None for x in pieces):
                raise ValueError("an index takes one digest of its pack")
            digest = hashlib.sha256()

            def body(pieces=pieces, end=end) -> Iterator[bytes]:
                yield bytes.fromhex(IDX)
                yield np.cumsum(sum((x[3] for x in pieces), np.zeros(256, np.int64))).astype(">u4").tobytes()
                for k in columns:
                    before = 0
                    for _, name, large, _, _ in pieces:
                        for data in segment(store, f"{base}/{name}-{k}"):
                            if k == 2:
                                places = np.frombuffer(data, ">u4").astype(np.int64)
                                data = np.where(places >= LARGE_OFFSET, places + before, places).astype(">u4").tobytes()
                            yield data
                        before += large
                yield bytes.fromhex(end)

            def sealed(body=body, digest=digest) -> Iterator[bytes]:
                for data in body():
                    digest.update(data)
                    yield data
                yield digest.digest()

            size = put(store, f"{base}/{pack}.idx", sealed())
            yield pd.DataFrame({"file": [f"{pack}.idx"], "size": [size], "digest": [digest.hexdigest()]})

    dealt = index.select("pack", "oid", "crc32", "offset").repartitionByRange("pack", id_).withColumn("id", id_).sortWithinPartitions("pack", "id", "offset").select("pack", "id", "crc32", "offset")
    pieces = cut(dealt.mapInPandas(segments, "pack string, part int, name string, large bigint, firsts array<bigint>"), "segments")
    ends = digests.select("pack", F.lit(-1).alias("part"), F.lit("").alias("name"), F.lit(0).alias("large"), F.array().cast("array<bigint>").alias("firsts"), F.col("digest").alias("end"))
    ordered = pieces.withColumn("end", F.lit(None).cast("string")).union(ends).repartition(tasks(index.sparkSession), "pack").sortWithinPartitions("pack", "part")
    written = cut(ordered.mapInPandas(join, "file string, size bigint, digest string"), "written")
    drop_segments(root, folder)
    return written


def write_multi_pack(index: DataFrame, root: str, file: str = "multi.midx") -> DataFrame:
    """index (pack, oid, offset), each id once, as one file: pack (its number in it), name. Packs are numbered by name."""
    names = index.select("pack").distinct().orderBy("pack").limit(PACKS_OF_A_MULTI + 1).collect()
    if len(names) > PACKS_OF_A_MULTI:
        raise ValueError(f"more than {PACKS_OF_A_MULTI} packs")
    numbers = index.sparkSession.createDataFrame([(i, r["pack"]) for i, r in enumerate(names)], "pack int, name string")
    rows = index.join(F.broadcast(numbers.withColumnRenamed("pack", "nth")), index["pack"] == F.col("name")).withColumn("file", F.lit(file))
    head = raw(MULTI + f"{len(names):08x}" + "".join(f"{i:08x}" for i in range(len(names))))
    start = index.sparkSession.range(1).withColumn("file", F.lit(file))
    parts = [_parts(start, 0, None, head), fanout_parts(rows, 1), _parts(rows, 2, "oid", F.unhex("oid")), _parts(rows, 3, "oid", number(F.col("nth"), 1)), _parts(rows, 4, "oid", number(F.col("offset"), 4))]
    write_parts(reduce(DataFrame.union, parts), root, "zeros")
    return numbers


def write_staging(index: DataFrame, root: str) -> DataFrame:
    """index (file, path, stage, oid, mode, size[, mtime]) as staging files of version 2, entries in the order of path and stage."""
    stat = [F.lit(0)] * 10
    stat[2] = F.coalesce("mtime", F.lit(0)) if "mtime" in index.columns else F.lit(0)
    stat[6], stat[9] = F.col("mode"), F.col("size")
    name = F.encode("path", "UTF-8")
    flags = F.col("stage") * 4096 + F.least(F.octet_length(name), F.lit(0xFFF))
    entry = F.concat(*[number(s, 4) for s in stat], F.unhex("oid"), number(flags, 2), name)
    padded = F.concat(entry, F.unhex(F.repeat(F.lit("00"), 8 - F.octet_length(entry) % 8)))
    head = index.groupBy("file").agg(F.count("*").alias("n"))
    key = F.concat("path", F.lit("\0"), F.col("stage").cast("string"))
    parts = _parts(head, 0, None, F.concat(raw(STAGING), number(F.col("n"), 4))).union(_parts(index.withColumn("key__", key), 1, "key__", padded))
    return write_parts(parts, root)


def write_commit_graph(rows: DataFrame, root: str, file: str = "commit-graph") -> DataFrame:
    """rows (position, oid, parent1, parent2, generation, commit_time) as one file; a missing parent is all ones."""
    named = cut(rows, "graph").withColumn("file", F.lit(file))
    parent = lambda c: number(F.coalesce(c, F.lit(NO_PARENT)), 4)
    data = F.concat(number(F.col("generation"), 4), number(F.col("commit_time"), 8), parent("parent1"), parent("parent2"))
    start = rows.sparkSession.range(1).withColumn("file", F.lit(file))
    return write_parts(reduce(DataFrame.union, [_parts(start, 0, None, raw(GRAPH)), fanout_parts(named, 1), _parts(named, 2, "oid", F.unhex("oid")), _parts(named, 3, "oid", data)]), root, "zeros")


def write_bundles(refs: DataFrame, objects: DataFrame, root: str) -> DataFrame:
    """refs (bundle, name, oid) and objects (bundle, oid, type, data[, base_oid]) as <bundle>.bundle: a header, then a pack."""
    entries = cut(_entries(objects.withColumnRenamed("bundle", "pack")), "entries").withColumn("file", F.concat("pack", F.lit(".bundle")))
    lines = refs.groupBy(F.concat("bundle", F.lit(".bundle")).alias("file")).agg(F.array_sort(F.collect_list(F.concat("oid", F.lit(" "), "name"))).alias("lines"))
    counts = lines.select("file").join(entries.groupBy("file").agg(F.count("*").alias("n")), "file", "left").fillna(0, ["n"])
    parts = [_parts(lines, 0, None, F.encode(bundle_header(F.col("lines")), "UTF-8")), _parts(counts, 1, None, F.concat(raw(PACK), number(F.col("n"), 4))), _parts(entries, 2, "oid", F.col("bytes"))]
    return write_parts(reduce(DataFrame.union, parts), root, sealed_from=1)
