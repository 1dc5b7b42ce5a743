"""SimHash near-duplicates by pivot distance tables.

Each fingerprint gets its Hamming distances to a fixed set of reference fingerprints (pivots). By the triangle inequality two
fingerprints within RADIUS of each other differ by at most RADIUS in every coordinate; pairs that differ by more in any one are
discarded, the rest are verified bit by bit.

Pivot tables tell pairs apart but do not bring them together, and comparing all pairs is out of the question. So the pairs
that are compared come from blocks: the 64 bits are cut into blocks of which a pair within RADIUS must agree on some, and a
row is filed once for every choice of that many blocks. No pair within RADIUS is missed. Equal fingerprints count as one
point, and only its members are numerous, so groups of copies cost nothing here. Buckets with more than SPLIT points are filed
again by further bits until they are small, with no pair lost either.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from cairnspark.llm.common import keep, lookup, over_texts, text_or_empty, texts_of
from cairnspark.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
PIVOTS = 14
LANES = 7  # distances to a 64-bit integer, 8 bits each; the sign bit stays free
CHUNK = 1 << 16  # shingles unpacked to bits at a time
SPLIT = 256  # points of a bucket that are compared in full; larger buckets are filed again by further bits
GROUPS, LEVELS = 6, 40  # of bits in a further filing; filings one after the other at most


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is 1 in over half the hashes of the text's shingles, repeats included; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long. A null or empty text has fingerprint 0."""
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, shingle) for t in texts_of(batch)], pa.int64())], ["doc_id", "fp"])

    return over_texts(picked, rows, "doc_id long, fp long")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of small numbers, so any two differ in about half the bits."""
    return [xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)]


def pivot_columns() -> dict[str, Column]:
    """The pivot table of column fp: pv0, pv1, ... with LANES distances in each."""
    ps, out = pivots(), {}
    for k in range(0, PIVOTS, LANES):
        terms = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("long"), 8 * i) for i, p in enumerate(ps[k : k + LANES])]
        out[f"pv{k // LANES}"] = reduce(lambda x, y: x.bitwiseOR(y), terms)
    return out


def coordinates_close(a: str, b: str) -> Column:
    """True if no coordinate of pivot tables a and b differs by more than RADIUS.

    In a lane, x - y + 128 + RADIUS is 128 or more exactly if y - x <= RADIUS; distances are 64 at most, so that no lane
    borrows from the next one.
    """
    ones = sum(1 << 8 * i for i in range(LANES))
    room, high = F.lit((128 + RADIUS) * ones), F.lit(128 * ones)
    tests = []
    for k in range(0, PIVOTS, LANES):
        x, y = F.col(f"{a}.pv{k // LANES}"), F.col(f"{b}.pv{k // LANES}")
        tests.append((x - y + room).bitwiseAND(y - x + room).bitwiseAND(high) == high)
    return reduce(lambda p, q: p & q, tests)


def block_masks(n_points: int) -> list[int]:
    """Masks of the keys under which a point is filed. Of m blocks RADIUS can be touched, so m - RADIUS agree. More points need
    longer keys, so that few strangers share one: keys have 27 or 32 bits. Either choice gives the same links."""
    m = 7 if n_points < 1 << 28 else 8
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(blocks[i] for i in pick) for pick in combinations(range(m), m - RADIUS)]


def further_masks(level: int) -> list[int]:
    """Masks of the bits that are added to a bucket's key. The 64 bits fall into GROUPS groups by lot, another lot at each level;
    RADIUS bits touch at most RADIUS groups, so a pair agrees on all of at least GROUPS - RADIUS of them."""
    order = np.random.default_rng(level).permutation(64).tolist()
    groups = [sum(1 << b for b in order[i::GROUPS]) for i in range(GROUPS)]
    return [sum(pick) for pick in combinations(groups, GROUPS - RADIUS)]


def file_under(points: DataFrame, masks: list[int]) -> DataFrame:
    """points (fp, mask, ...), once for each mask, with the bits of its key (mask) and the key (bucket)."""
    more = F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("more")
    rows = points.select("*", more).withColumn("mask", F.col("mask").bitwiseOR(F.col("more"))).drop("more")
    return rows.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def distances(n: int) -> list[Column]:
    """The first n distances of a pivot table."""
    return [F.shiftright(F.col("pv0"), 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(n)]


def links(points: DataFrame, n_points: int) -> DataFrame:
    """points (node, fp; fp unique) to edges (a, b) that connect exactly the points connected by links of RADIUS or less.

    Not every link is returned, as a dense group has as many as its size squared. First each point of a bucket is compared with
    its neighbour in the order of pivot distances, which joins up dense groups by as many edges as rows. Then buckets with points
    of several components so far are searched in full for links between components. Either way a pair is verified bit by bit only
    if its pivot tables do not rule it out.
    """
    masks = F.array(*[F.lit(signed(m)) for m in block_masks(n_points)])
    total = n_points * len(block_masks(n_points))
    filed = points.select("node", "fp", F.posexplode(masks).alias("pick", "mask"))
    filed = filed.select("node", "fp", F.col("pick").cast("byte").alias("pick"), F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    # points that are alone in a bucket go; a bucket that holds a large share of them is met in several tasks
    sizes = keep(filed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    near = lookup(filed, sizes, "bucket", "n", total, "node", merge=True).where("n is not null").withColumns(pivot_columns())
    near = keep(near.withColumn("mask", F.get(masks, F.col("pick"))).drop("pick"), "filed")

    cell = F.when(F.col("n") > SPLIT, F.array(*distances(3))).otherwise(F.array(F.lit(0).cast("long")))
    order = Window.partitionBy("bucket", "cell").orderBy(*distances(4), "fp")
    before = F.lag(F.struct("node", "fp", "pv0", "pv1")).over(order)
    pairs = near.withColumn("cell", cell).select(F.struct("node", "fp", "pv0", "pv1").alias("x"), before.alias("y")).where("y is not null")
    first = keep(pairs.where(coordinates_close("x", "y") & linked("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "links")

    rows, across = near.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node")), []
    rows = keep(rows.select("node", "fp", "pv0", "pv1", "mask", "bucket", "root"), "labelled")
    for level in range(LEVELS):
        mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket", "n")
        open_ = keep(lookup(rows, mixed, "bucket", "n", total, "node").where("n is not null"), "open")
        small = open_.where(F.col("n") <= SPLIT)
        x, y = small.alias("x"), small.alias("y")
        pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & coordinates_close("x", "y") & linked("x", "y"))
        across.append(keep(pairs.groupBy(F.col("x.root").alias("a"), F.col("y.root").alias("b")).agg(F.count("*").alias("n")).select("a", "b"), "links"))
        large = open_.where(F.col("n") > SPLIT).drop("n")
        if large.isEmpty():
            return reduce(DataFrame.union, across, first)
        rows = keep(file_under(large.drop("bucket"), further_masks(level)), "refiled")
    raise RuntimeError(f"buckets of over {SPLIT} points after {LEVELS} filings")


def linked(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RADIUS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id, the smallest id that a chain of links reaches.

    Texts without a word have fingerprint 0 and are linked like any other. A row with a null id gets the component of the rows
    with an id and the same fingerprint, or null if there are none, and links nothing itself. An empty table gives no rows.
    """
    prints = keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    total = prints.count()
    same = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "points")
    points = same.where("node is not null").select("node", "fp")
    found = components(links(points, same.count()))
    roots = same.join(found, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    return lookup(prints, roots, "fp", "n", total).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest id.

    Rows without an id all stay, and so do rows that repeat the smallest id; exact deduplication removes those. Rows travel in one
    struct, so columns of docs may have any names.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
