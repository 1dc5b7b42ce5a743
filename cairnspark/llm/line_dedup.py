"""Line deduplication over an index that takes insertions and deletions of documents.

The exact part is a table of postings, one row for each line key and document that holds it, and a table of reference counts.
In front of it stand cuckoo filters, one a shard of the keys, that hold the keys found in enough documents. A cuckoo filter can
forget: when deletions bring a key below the limit, its fingerprint is taken out again and its lines are back. Scans test
lines against the filters and look up what passes in the exact table, so a false positive costs a lookup and nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cairnspark.llm.common import bounded_batches, keep, lookup, over_texts, text_or_empty, texts_of

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"
SLOTS, KICKS = 4, 500
KEYS_A_SHARD = 200_000
#: Filters up to this many bytes in all are broadcast; beyond it the keys, 16 bytes each, are sent to the filter of their shard.
MAX_FILTER_BYTES = 64 << 20
SLICES = 16  # tasks that may share a shard's filter, so that a key in a third of all documents is in no single task


class Cuckoo:
    """Buckets of SLOTS 16-bit fingerprints; 0 is an empty slot. The other bucket of a fingerprint follows from either one."""

    def __init__(self, data: bytes | int) -> None:
        if isinstance(data, int):
            buckets = 1 << max(4, (max(data, 1) * 10 // (SLOTS * 8)).bit_length())
            self.table = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = len(self.table) - 1

    @staticmethod
    def prints(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        return halves[:, 0], (halves[:, 1] >> np.uint64(40)).astype(np.uint16) | np.uint16(1)

    def _other(self, bucket, mark):
        return (bucket ^ (int(mark) * 0x5BD1E995)) & self.mask

    def add(self, keys: list[bytes]) -> bool:
        """False if a key finds no place; the caller builds a larger filter from the exact table then."""
        homes, marks = self.prints(keys) if keys else ([], [])
        rng = np.random.default_rng(len(keys))
        for home, mark in zip(homes, marks, strict=True):
            at = int(home) & self.mask
            for _ in range(KICKS):
                for bucket in (at, self._other(at, mark)):
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    at = self._other(at, mark)
                    slot = int(rng.integers(SLOTS))
                    mark, self.table[at, slot] = self.table[at, slot], mark
                    at = self._other(at, mark)
                    continue
                break
            else:
                return False
        return True

    def remove(self, keys: list[bytes]) -> None:
        """Of keys that were added."""
        for home, mark in zip(*(self.prints(keys) if keys else ([], [])), strict=True):
            at = int(home) & self.mask
            for bucket in (at, self._other(at, mark)):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        homes, marks = self.prints(keys)
        at = (homes & np.uint64(self.mask)).astype(np.int64)
        other = (at ^ (marks.astype(np.int64) * 0x5BD1E995)) & self.mask
        return (self.table[at] == marks[:, None]).any(1) | (self.table[other] == marks[:, None]).any(1)

    def data(self) -> bytes:
        return self.table.tobytes()


def key_of(line: bytes) -> bytes | None:
    """128-bit hash of the line, stripped of ASCII white space and A-Z lower-cased; None if shorter than MIN_CHARS code points."""
    line = line.strip(SPACE)
    if len(line) < MIN_CHARS or (len(line) < 4 * MIN_CHARS and len(line.decode()) < MIN_CHARS):
        return None
    return xxh3_128_digest(line.lower())


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id), each once. Rows with a null id hold no lines."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            own = {k for k in map(key_of, set(text.split(b"\n"))) if k}
            keys += own
            ids += [doc] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return over_texts(_docs(docs, id_col, text_col).where("doc_id is not null"), rows, "key binary, doc_id long").dropDuplicates(["key", "doc_id"])


def _shard(shards: int) -> Column:
    return (F.crc32("key") % shards).cast("int")


class LineIndex:
    """An immutable state: insert() and delete() return the next one, and the tables of this one stay valid."""

    def __init__(self, spark: SparkSession, held: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int) -> None:
        self.spark, self.held, self.counts, self.filters, self.shards, self.min_docs = spark, held, counts, filters, shards, min_docs

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 1, min_docs: int = MIN_DOCS) -> LineIndex:
        return cls(spark, spark.createDataFrame([], "key binary, doc_id long"), spark.createDataFrame([], "key binary, n_docs long, last_doc long"), spark.createDataFrame([], "shard int, data binary"), shards, min_docs)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> LineIndex:
        """An index of docs, with as many shards as its repeated keys need."""
        held = keep(postings(docs, id_col, text_col), "postings")
        counts = keep(_count(held), "counts")
        return cls._of(docs.sparkSession, held, counts, _shards(counts, min_docs), min_docs)

    @classmethod
    def _of(cls, spark: SparkSession, held: DataFrame, counts: DataFrame, shards: int, min_docs: int) -> LineIndex:
        """With filters made anew from the exact counts."""
        start = cls.empty(spark, shards, min_docs)
        return cls(spark, held, counts, start._refilter(counts.withColumn("was", F.lit(0).cast("long")), counts), shards, min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Documents that are already held count once, as before. When the repeated keys outgrow the shards, there are twice as many
        shards or more from then on, so that no filter, and no group that makes one, grows with the index."""
        new = keep(postings(docs, id_col, text_col).join(self.held, ["key", "doc_id"], "left_anti"), "postings")
        both = self.counts.select("key", "n_docs", "last_doc", F.col("n_docs").alias("was")).union(_count(new).select("key", "n_docs", "last_doc", F.lit(0).cast("long")))
        merged = keep(both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.sum("was").alias("was")), "counts")
        counts, held = merged.drop("was"), self.held.union(new)
        if (shards := _shards(counts, self.min_docs)) > self.shards:
            return self._of(self.spark, held, counts, shards, self.min_docs)
        return LineIndex(self.spark, held, counts, self._refilter(merged, counts), self.shards, self.min_docs)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents of these ids; ids that are not held change nothing."""
        gone = ids.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
        held = keep(self.held.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "postings")
        now = _count(held)
        merged = keep(self.counts.select("key", F.col("n_docs").alias("was")).join(now, "key", "left").select("key", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "last_doc", "was"), "counts")
        counts = merged.where("n_docs > 0").drop("was")
        return LineIndex(self.spark, held, counts, self._refilter(merged, counts), self.shards, self.min_docs)

    def _refilter(self, merged: DataFrame, counts: DataFrame) -> DataFrame:
        """The filters after the changes in merged (key, n_docs, was): keys that crossed the limit go in or come out."""
        least, shards = self.min_docs, self.shards
        now, was = F.col("n_docs") >= least, F.col("was") >= least
        changed = merged.where(now != was).select(_shard(shards).alias("shard"), "key", now.alias("add"))
        bounded_batches(self.spark)

        def update(old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            shard = int((old if len(old) else changes)["shard"].iloc[0])
            out, add = [k for k, a in zip(changes["key"], changes["add"], strict=True) if not a], [k for k, a in zip(changes["key"], changes["add"], strict=True) if a]
            table = Cuckoo(bytes(old["data"].iloc[0]) if len(old) else len(add))
            table.remove(out)
            done = table.add(add)
            return pd.DataFrame({"shard": [shard], "data": [table.data() if done else None]}).astype({"shard": "int32"})

        first = keep(self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(update, "shard int, data binary"), "filters")
        full = first.where("data is null").select("shard")
        if full.isEmpty():
            return first

        def rebuild(rows: pd.DataFrame) -> pd.DataFrame:
            keys, room = list(rows["key"]), len(rows)
            while not (table := Cuckoo(room)).add(keys):
                room *= 2
            return pd.DataFrame({"shard": rows["shard"].iloc[:1], "data": [table.data()]})

        keys = counts.where(F.col("n_docs") >= least).select(_shard(shards).alias("shard"), "key").join(full, "shard", "left_semi")
        return keep(first.where("data is not null").union(keys.groupBy("shard").applyInPandas(rebuild, "shard int, data binary")), "filters")

    def _tester(self):
        """A function from keys to those that may be repeated, with the filters broadcast."""
        shared, shards = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in self.filters.collect()}), self.shards
        opened: dict[int, Cuckoo] = {}

        def test(keys: list[bytes]) -> set[bytes]:
            by_shard: dict[int, list[bytes]] = {}
            for k in keys:
                by_shard.setdefault(zlib.crc32(k) % shards, []).append(k)
            out: set[bytes] = set()
            for shard, own in by_shard.items():
                if shard in shared.value:
                    if shard not in opened:
                        opened[shard] = Cuckoo(shared.value[shard])
                    out.update(k for k, hit in zip(own, opened[shard].has(own), strict=True) if hit)
            return out

        return test

    def _sent_to_filters(self, keyed: DataFrame) -> DataFrame:
        """The rows of keyed (key, doc_id) whose key may be repeated. A filter comes first in its part, its keys follow as a stream."""
        none = lambda kind: F.lit(None).cast(kind)
        rows = keyed.select(_shard(self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"), "key", "doc_id", none("binary").alias("data"))
        parts = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), none("binary").alias("key"), none("long").alias("doc_id"), "data")
        dealt = parts.union(rows).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "shard", "slice").sortWithinPartitions("shard", "slice", F.col("data").isNull())
        bounded_batches(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, table = None, None
            for batch in batches:
                part = batch.column(0).to_numpy().astype(np.int64) * SLICES + batch.column(1).to_numpy()
                keys, data, hit = batch.column(2).to_pylist(), batch.column(4), np.zeros(len(part), bool)
                starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for lo, hi in zip(starts, starts[1:], strict=False):
                    if lo == hi:
                        continue
                    if part[lo] != at:
                        at, table = part[lo], None
                    if data[lo].is_valid:
                        table, lo = Cuckoo(data[lo].as_py()), lo + 1
                    if table:
                        hit[lo:hi] = table.has(keys[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], ["key", "doc_id"]).filter(pa.array(hit))

        return dealt.mapInArrow(run, "key binary, doc_id long")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each row of docs: doc_id, n_lines, n_dropped, text.

        A line whose key at least min_docs documents of the index hold is dropped, unless this document has the largest id
        among them. Lines are split at \\n; a null or empty text is one empty line; a text of which all lines go is empty.
        Keys shorter than MIN_CHARS never count. Rows with a null id keep their lines. Documents that the filters clear are
        not shuffled while the filters can be broadcast.
        """
        many = keep(self.counts.where(F.col("n_docs") >= self.min_docs), "repeated")
        total = many.agg(F.sum("n_docs")).first()[0] or 0
        going = lambda lines: lookup(lines, many, "key", "n_docs", total).where("doc_id < last_doc").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
        size = self.filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        if size > MAX_FILTER_BYTES:
            gone = going(self._sent_to_filters(postings(docs, id_col, text_col)))
            counted = _docs(docs, id_col, text_col).withColumn("n_lines", F.lit(0).cast("long"))
            return counted.join(gone, "doc_id", "left").mapInArrow(_drop_lines, CLEAN)
        test = self._tester()

        def flag(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            texts = texts_of(batch)
            keys = [{k for k in map(key_of, set(t.split(b"\n"))) if k} for t in texts]
            hits = test(list(set().union(*keys)))
            for own in keys:
                found.append(sorted(own & hits) or None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "text", "n_lines", "hits"])

        flagged = over_texts(_docs(docs, id_col, text_col), flag, "doc_id long, text string, n_lines long, hits array<binary>")
        suspect = F.col("hits").isNotNull() & F.col("doc_id").isNotNull()
        lines = flagged.where(suspect).select("doc_id", F.explode("hits").alias("key")).distinct()
        gone = going(lines)
        touched = flagged.where(suspect).select("doc_id", "text", "n_lines").join(gone, "doc_id", "left")
        rest = flagged.where(~suspect).select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "text")
        return rest.union(touched.mapInArrow(_drop_lines, CLEAN))


CLEAN = "doc_id long, n_lines long, n_dropped long, text string"


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, n_lines, gone to CLEAN."""
    for batch in batches:
        texts, sizes, dropped = [], [], []
        for text, out in zip(texts_of(batch), batch.column(3).to_pylist(), strict=True):
            lines, out = text.split(b"\n"), set(out or ())
            left = [x for x in lines if key_of(x) not in out] if out else lines
            sizes.append(len(lines))
            dropped.append(len(lines) - len(left))
            texts.append(b"\n".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def _shards(counts: DataFrame, min_docs: int) -> int:
    """A power of two of shards, none of which has many more than KEYS_A_SHARD repeated keys."""
    many = counts.where(F.col("n_docs") >= min_docs).count()
    return max(1, 1 << (-(-many // KEYS_A_SHARD) - 1).bit_length()) if many else 1


def _count(held: DataFrame) -> DataFrame:
    return held.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
