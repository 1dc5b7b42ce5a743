"""Best-fit packing of documents into training sequences by bin completion.

Only lengths matter to packing, and a piece is at most `capacity` ids long. So the problem is a histogram of at most `capacity`
counts, whatever the number of documents. The driver packs the histogram: every filling that it chooses is a pattern, applied
as often as the counts allow. Documents then take the places that the plan holds for their length, each by its rank among the
pieces of that length, in parallel and without meeting in one group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.byte_bpe import encoder, vocabulary_path
from cairnspark.llm.common import bounded_batches, keep, text_or_empty

CAPACITY = 1024
END_ID = 2
NODES = 12_000  # branch-and-bound nodes; the incumbent stands if no better packing is found within them
STEPS = 40  # partial fillings looked at for each of these nodes, on the average; the search ends there too

Filling = tuple[int, ...]
Pattern = tuple[Filling, int]  # lengths in a sequence, number of such sequences
Items = tuple[int, int]  # a length, number of such items in a filling


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: open sequences are kept as groups of equal content by the room left."""
    rooms: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, g in rooms.items() if r >= length and g), default=None)
            content, many = rooms[room].pop() if room is not None else [(), -(-left // (capacity // length))]
            room = capacity if room is None else room
            each = room // length
            full = min(many, left // each)
            if full:
                rooms.setdefault(room - each * length, []).append([content + (length,) * each, full])
                left -= full * each
                many -= full
            if many and left:  # fewer than one sequence takes
                rooms.setdefault(room - left * length, []).append([content + (length,) * left, 1])
                many, left = many - 1, 0
            if many and content:
                rooms.setdefault(room, []).append([content, many])
    return [(tuple(c), n) for groups in rooms.values() for c, n in groups]


def spread(sums: int, length: int, times: int) -> int:
    """The sums, a bit each, with up to so many items of a length added."""
    step = 1
    while times > 0:
        n = min(step, times)
        sums |= sums << length * n
        times, step = times - n, 2 * step
    return sums


def dominated(taken: tuple[Items, ...], sums: int, have: list[int], lengths: int, slack: int, above: int) -> bool:
    """True if an item over `above` that is left fits in the place of some items of the filling, or of none, so that the room is
    used at least as well. Every dominated filling has such an exchange.

    sums: bits of what items of the filling add up to; lengths: bits of the lengths that there are.
    """
    own = 0
    for length, _ in taken:
        own |= 1 << length
    if spread(sums, 1, slack) & (lengths & ~own) >> above + 1 << above + 1:
        return True
    for length, n in taken:
        if length > above and have[length] > n:
            others = 1
            for other, m in taken:
                others = others if other == length else spread(others, other, m)
            if spread(others, 1, slack) >> length & 1:
                return True
    return False


def fillings(room: int, have: list[int], waste: int, steps: list[int]) -> Iterator[Filling]:
    """All undominated fillings of the room that waste no more than allowed, fullest first and of these the largest items first.

    have: how many of each length are left. A filling takes as many items as fit. They are made as they are asked for; steps[0] is
    what may still be tried on the way.
    """
    fit = [k for k in range(1, min(room, len(have) - 1) + 1) if have[k]]
    below, whole, bits = [1], (1 << room + 1) - 1, 0  # sums of the smallest lengths
    for k in fit:
        below.append(spread(below[-1], k, min(have[k], room // k)) & whole)
        bits |= 1 << k

    def complete(i: int, left: int, taken: tuple[Items, ...], sums: int, slack: int) -> Iterator[Filling]:
        if not left:
            if not dominated(taken, sums, have, bits, slack, 0):
                yield tuple(k for k, n in taken for _ in range(n))
            return
        j = min(i, bisect_right(fit, left))
        while j and below[j] >> left & 1 and steps[0] > 0:
            k = fit[j - 1]
            for n in range(min(have[k], left // k), 0, -1):
                if below[j - 1] >> left - k * n & 1:
                    steps[0] -= 1
                    more, reached = (*taken, (k, n)), spread(sums, k, n)
                    if not dominated(more, reached, have, bits, slack, k):
                        yield from complete(j - 1, left - k * n, more, reached, slack)
            j -= 1

    for total in range(room, max(room - waste, 0) - 1, -1):
        if below[-1] >> total & 1:
            yield from complete(len(fit), total, (), 1, room - total)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """As few sequences as found: best fit first, then branch and bound on fillings around the largest document left.

    A filling is applied as often as its items last; other branches apply it half as often, and once. A branch is left as soon as
    its waste rules out a packing with one sequence less than the incumbent; a packing that meets the bound
    ceil(total / capacity) ends the search.
    """
    best = best_fit({k: v for k, v in counts.items() if v}, capacity)
    first = [counts.get(k, 0) for k in range(capacity + 1)]
    total = sum(k * n for k, n in enumerate(first))
    used, least, steps = sum(n for _, n in best), -(-total // capacity), [STEPS * nodes]

    def choices(have: list[int], allowed: int) -> Iterator[tuple[Filling, int]]:
        top = max(k for k, n in enumerate(have) if n)
        rest = have.copy()
        rest[top] -= 1
        for filling in fillings(capacity - top, rest, allowed, steps):
            pattern = (top, *filling)
            times = min(have[k] // n for k, n in Counter(pattern).items())
            waste = capacity - sum(pattern)
            if waste:
                times = max(1, min(times, allowed // waste))
            for n in dict.fromkeys((times, -(-times // 2), 1)):
                yield pattern, n

    stack: list[tuple[list[int], tuple | None, int, Iterator]] = []
    if used > least:
        stack.append((first, None, 0, choices(first, (used - 1) * capacity - total)))
    while stack and nodes and used > least:
        have, plan, wasted, more = stack[-1]
        pattern, times = next(more, ((), 0))
        if not times:
            stack.pop()
            continue
        nodes -= 1
        wasted += (capacity - sum(pattern)) * times
        allowed = (used - 1) * capacity - total - wasted
        if allowed < 0:
            if times == 1:  # those that follow waste as much
                stack.pop()
            continue
        left, plan = have.copy(), (plan, (pattern, times))
        for k in pattern:
            left[k] -= times
        if any(left):
            stack.append((left, plan, wasted, choices(left, allowed)))
            continue
        best = []
        while plan:
            plan, one = plan
            best.append(one)
        used = sum(n for _, n in best)
    return best


def runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, places in a sequence, first offset), by length and rank.

    Their number follows from the capacity, not from the corpus.
    """
    out, rank, sequence = [], Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            out.append((length, rank[length], sequence, n, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """A document's ids and end_id, cut into pieces of capacity of which the first may be shorter; part and nth number the
    pieces of a length that a task has made."""
    end = end_id.to_bytes(4, "little")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = encoder(vocabulary).ids, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = memoryview(ids(text) + end)
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if k == 0 else capacity
                    rows.append((doc, k, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
                    at, k = at + length, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with end_id alone. Rows that repeat an id are packed one by one, null ids too. Texts of
    any length are cut, never shortened. Places in a sequence follow one another from 0 without gaps. An empty table gives no
    rows. Other columns of docs do not matter.
    """
    cut = keep(pieces(docs, id_col, text_col, capacity, end_id, vocabulary or vocabulary_path()), "pieces")
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = keep(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "ranks")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = docs.sparkSession.sparkContext.broadcast(runs(bin_completion(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length0, rank0, sequence0, places, offset0 = plan.value.T
        starts = length0 << 44 | rank0
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(starts, length << 44 | rank, "right") - 1
            nth = rank - rank0[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence0[i] + nth // places[i]), pa.array(offset0[i] + nth % places[i] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(per_task.select("part", "length", "base"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
