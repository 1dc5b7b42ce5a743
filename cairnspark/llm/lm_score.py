"""Language-model scores by subword lattices.

A word is spelled by every way of cutting it into vocabulary pieces. The existing scores of a unigram vocabulary weight the
pieces at first; expectation steps over all words of the training documents adjust them to the corpus. A forward recursion in
log space sums over all segmentations. The words of the training documents are edges of the lattice too, one from end to end of
a word, weighted by their discounted counts; the discounted mass goes to the pieces. A document's log probability is the sum over
its words and its end, as no edge crosses white space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import bounded_batches, keep, text_or_empty, texts_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
STEPS = 2  # expectation steps
PRIOR_PIECES = 1000.0  # weight of the existing scores beside the expected counts
END_SHARE = 0.01  # of the probability that pieces spell, for the end of a text
HELD_OUT = (7, 2)  # rows with crc32(doc_id as text) mod 7 = 2 are not learned from
#: Words with more than 1/HOT_WORDS of all tokens are fewer than HOT_WORDS; they are broadcast, the others are joined.
HOT_WORDS = 100_000
FLUSH = 200_000  # distinct words that a task counts before it passes them on
LONG = 48  # code points up to which words are spelled together, longer ones one by one
BLOCK_WORDS = 40_000  # words that a task spells at a time
CELLS = 1 << 20  # piece positions that a block of words has at a time
NONE = -np.inf


def model_path() -> str:
    return public_tokenizers.path(MODEL)


class Pieces:
    """The pieces that may spell a lower-case word with a space mark before it, found by hashes of substrings.

    A character that is no piece is spelled by its bytes. Hashes of 64 bits are taken to be unique among pieces; equality of a
    substring's hash with a piece's stands for equality.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.strings, scores = [""], [0.0]
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
            if not special and MARK not in p[1:] and not any("A" <= c <= "Z" for c in p):
                self.strings.append(p)
                scores.append(model.get_score(i))
        score = np.array(scores[1:])
        # files made by pair merging hold negative ranks, not log probabilities: their weights follow the rank as in Zipf's law
        weight = 1 / (2.7 - score) if score.min() < -1000 else np.exp(score)
        self.bytes_weight = weight.min()
        total = weight.sum() + 256 * self.bytes_weight
        self.prior = np.concatenate([[0.0], weight / total])
        self.log_byte = float(np.log(self.bytes_weight / total))
        self.id_of = {p: i for i, p in enumerate(self.strings) if i}
        self.longest = max(map(len, self.strings))
        keys = np.array([self.hash(p) for p in self.strings[1:]], np.uint64)
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.tries = 1
        for k, i in zip(keys.tolist(), range(1, len(self.strings)), strict=True):
            at, n = k >> int(self.shift), 1
            while self.ids[at]:
                at, n = (at + 1) & ((1 << bits) - 1), n + 1
            self.keys[at], self.ids[at], self.tries = k, i, max(self.tries, n)

    def hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * self.BASE) % (1 << 64)
            h ^= h >> 31
        return h

    def grid(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) to the piece ids of that substring in each row of chars (words of one length); 0: no piece."""
        n, width = chars.shape
        codes, out = chars.astype(np.uint64) + np.uint64(1), {}
        for start in range(width):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                h = (h + codes[:, end - 1]) * np.uint64(self.BASE)
                h ^= h >> np.uint64(31)
                at, found = (h >> self.shift).astype(np.int64), np.zeros(n, np.int32)
                for _ in range(self.tries):
                    np.copyto(found, self.ids[at], where=(self.keys[at] == h) & (found == 0))
                    at = (at + 1) & (len(self.keys) - 1)
                if end == start + 1 or found.any():
                    out[start, end] = found
        return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    stacked = np.stack(terms)
    top = stacked.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(0))


def blocks(words: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and code points of words of equal length, each with the space mark before it, a block at a time."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w) + 1, []).append(i)
    for width, own in by_length.items():
        step = max(1, CELLS // (width * min(width, longest)))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            text = "".join(MARK + words[i] for i in part)
            yield np.array(part), np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), width)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins batches to blocks of BLOCK_WORDS rows or a little more: few words of one length are slow to spell together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_WORDS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Lattice:
    """Pieces with the natural logarithms of their probabilities."""

    def __init__(self, known: Pieces, probability: np.ndarray) -> None:
        self.known = known
        with np.errstate(divide="ignore"):
            self.log = np.log(probability)
        self.log[0] = NONE

    def _edges(self, chars: np.ndarray) -> tuple[dict, dict[int, list]]:
        """Log weights of all edges by (start, end), and for each end its starts. Bytes spell characters that are no piece."""
        grid = self.known.grid(chars)
        logs, into = {}, {}
        for (start, end), ids in grid.items():
            value = self.log[ids]
            if end == start + 1 and not ids.all():
                missing = np.flatnonzero(ids == 0)
                code = chars[missing, start].astype(np.int64)
                value[missing] = self.log_byte_count(code) * self.known.log_byte
            logs[start, end] = value
            into.setdefault(end, []).append(start)
        return logs, into, grid

    @staticmethod
    def log_byte_count(code: np.ndarray) -> np.ndarray:
        return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)

    def _forward(self, logs: dict, into: dict, n: int, width: int) -> list[np.ndarray]:
        alpha = [np.zeros(n)]
        for end in range(1, width + 1):
            alpha.append(log_sum([alpha[s] + logs[s, end] for s in into[end]]))
        return alpha

    def spell(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, summed over its segmentations."""
        out = np.zeros(len(words))
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._spell_long(MARK + w)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for part, chars in blocks([words[i] for i in short], self.known.longest):
            logs, into, _ = self._edges(chars)
            out[np.array(short)[part]] = self._forward(logs, into, *chars.shape)[-1]
        return out

    def _into(self, word: str, end: int) -> list[tuple[int, int, float]]:
        """Edges of a word that end there: start, piece (0 for bytes), log weight."""
        id_of, log = self.known.id_of, self.log
        out = [(start, i, log[i]) for start in range(max(0, end - self.known.longest), end) if (i := id_of.get(word[start:end]))]
        if word[end - 1] not in id_of:
            out.append((end - 1, 0, len(word[end - 1].encode()) * self.known.log_byte))
        return out

    def _forward_long(self, word: str) -> list[float]:
        alpha = [0.0]
        for end in range(1, len(word) + 1):
            terms = [alpha[start] + weight for start, _, weight in self._into(word, end)]
            top = max(terms, default=NONE)
            alpha.append(top + float(np.log(sum(np.exp(t - top) for t in terms))) if top > NONE else NONE)
        return alpha

    def _spell_long(self, word: str) -> float:
        """The same recursion in one pass over a word of any length."""
        return self._forward_long(word)[-1]

    def _expect_long(self, word: str, out: np.ndarray) -> None:
        """Adds the expected uses of pieces in a word of any length to out."""
        alpha = self._forward_long(word)
        if alpha[-1] == NONE:
            return
        beta = [NONE] * len(word) + [0.0]
        for end in range(len(word), 0, -1):
            if beta[end] == NONE:
                continue
            for start, i, weight in self._into(word, end):
                after = weight + beta[end]
                beta[start] = float(np.logaddexp(beta[start], after))
                out[i] += np.exp(alpha[start] + after - alpha[-1])

    def expect(self, words: list[str]) -> np.ndarray:
        """Expected number of times each piece is used to spell these words, by a forward and a backward pass."""
        out = np.zeros(len(self.log))
        for w in words:
            if len(w) > LONG:
                self._expect_long(MARK + w, out)
        for _, chars in blocks([w for w in words if len(w) <= LONG], self.known.longest):
            n, width = chars.shape
            logs, into, grid = self._edges(chars)
            alpha = self._forward(logs, into, n, width)
            beta: list[list[np.ndarray]] = [[] for _ in range(width)] + [[np.zeros(n)]]
            for end in range(width, 0, -1):
                after = log_sum(beta[end]) if beta[end] else np.full(n, NONE)
                for start in into[end]:
                    with np.errstate(invalid="ignore"):
                        share = np.exp(alpha[start] + logs[start, end] + after - alpha[-1])
                    out += np.bincount(grid[start, end], np.nan_to_num(share), len(out))
                    beta[start].append(logs[start, end] + after)
        out[0] = 0
        return out


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c, a): occurrences in training documents and in all documents. docs: doc_id, text, held_out."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {True: Counter(), False: Counter()}

        def flush() -> pa.RecordBatch:
            rows = [(w, 0 if out else n, n) for out, own in found.items() for w, n in own.items()]
            for own in found.values():
                own.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["word", "c", "a"])

        for batch in batches:
            for text, out in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
                found[out].update(text.lower().split())
            if sum(map(len, found.values())) > FLUSH:
                yield flush()
        yield flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def decoded(words: list[bytes]) -> list[str]:
    return [w.decode() for w in words]


def learn(words: DataFrame, path: str, steps: int = STEPS) -> np.ndarray:
    """Piece probabilities after expectation steps over all distinct training words, each of weight one: pieces are to spell
    words that were not seen, and those are like the rare words, not like the frequent ones."""
    known = pieces(path)
    probability, n = known.prior, len(known.strings)
    for _ in range(steps):
        shared = words.sparkSession.sparkContext.broadcast(probability)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces(path), shared.value), 0.0
            for batch in gather(batches):
                total = total + lattice.expect(decoded(batch.column(0).to_pylist()))
            used = np.flatnonzero(total) if np.ndim(total) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used] if len(used) else [], pa.float64())], ["piece", "expected"])

        rows = words.where("c > 0").select("word").mapInArrow(run, "piece long, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).collect()
        expected = np.zeros(n)
        for r in rows:  # as many as there are pieces
            expected[r["piece"]] = r["expected"]
        mass = expected + PRIOR_PIECES * known.prior
        probability = mass / mass.sum() * known.prior.sum() if expected.sum() else known.prior
    return probability


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are words, A-Z lower-cased, and one end a text; a null or empty text is an end alone. base_score is the unigram model
    with one added to each count. Rows that repeat an id are scored one by one; null ids are not held out. With nothing to learn
    from, base_score is 0 and pieces alone spell. Words of any length are scored whole.
    """
    spark, path = docs.sparkSession, model or model_path()
    bounded_batches(spark)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("held_out", held_out())
    words = keep(word_counts(plain), "words")
    ends = plain.select("held_out").where("not held_out").count()
    facts = words.agg(F.sum("c"), F.sum("a"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    in_words, everywhere, types, once, twice = (int(x or 0) for x in facts)
    tokens, vocabulary = in_words + ends, types + (ends > 0)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    spare = discount * vocabulary / tokens if tokens else 1.0
    base_all = float(np.log10(tokens + vocabulary + 1))
    base_end = float(np.log10(ends + 1)) - base_all
    score_end = float(np.log10((max(ends - discount, 0) / tokens if tokens else 0.0) + spare * END_SHARE))
    shared = spark.sparkContext.broadcast(learn(words, path))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces(path), shared.value)
        for batch in gather(batches):
            c = batch.column(1).to_numpy().astype(float)
            by_pieces = lattice.spell(decoded(batch.column(0).to_pylist())) + np.log(spare * (1 - END_SHARE))
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / max(tokens, 1)) if tokens else np.full(len(c), NONE)
            both = np.logaddexp(by_pieces, whole) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(both)], ["word", "c", "a", "p"])

    priced = keep(words.mapInArrow(spell, "word binary, c long, a long, p double"), "priced")
    hot = priced.where(F.col("a") > everywhere / HOT_WORDS).collect()  # fewer than HOT_WORDS
    prices = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"] > 0, float(np.log10(r["c"] + 1)), r["p"]) for r in hot})

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with what its hot words come to, and a row for each other word in it."""
        table, part, nth = prices.value, TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows = []
            for doc, text, out in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
                row, found = part + nth, Counter(text.lower().split())
                nth += 1
                known, base, total = int(ends > 0), base_end, score_end
                for w, n in found.items():
                    at = table.get(w)
                    if at is None:
                        rows.append((row, None, None, n, None, None, None, w))
                    else:
                        known += n * at[0]
                        base += n * (at[1] - base_all)
                        total += n * at[2]
                rows.append((row, doc, out, found.total() + 1, known, base, total, None))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "held_out", "n", "known", "base", "total", "word"])

    bags = keep(plain.mapInArrow(price, "row long, doc_id long, held_out boolean, n long, known long, base double, total double, word binary"), "bags")
    rare = bags.where("word is not null").select("row", "n", "word").join(priced.select("word", "c", "p"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * (F.log10(F.col("c") + 1) - base_all)).alias("base2"), F.sum(F.col("n") * F.col("p")).alias("total2"))
    whole = bags.where("word is null").drop("word").join(rare, "row", "left")
    added = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return whole.select("doc_id", "held_out", F.col("n").alias("n_tokens"), added("known", "known2").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), added("base", "base2").alias("base_score"), added("total", "total2").alias("score"))
