"""SentencePiece encoding and decoding on the pieces and scores of a model file.

Encoding is the segmentation with the largest sum of piece scores. An Aho-Corasick automaton over all pieces reads a text
once; at each position its output links give every piece that ends there, and each relaxes the best score of that position.
No piece has a space mark after another character, so a piece never crosses the boundary before a mark: stretches between such
boundaries are encoded one by one, mostly from a cache. Characters without a piece become byte pieces.

Scores are those of the model file as they stand. For a unigram model this is what the library returns; for a file made by
pair merging it is the best path under the same scores, not the order of merges.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import over_texts, text_or_empty

MODEL = "piece_bpe_32k.model"
MARK = "▁"
STRETCH = re.compile(f"{MARK}+[^{MARK}]*")
BLOCK = 4 << 20  # bytes of text whose stretches are looked up together
UNKNOWN_PENALTY = 10.0  # below the lowest score, for a character that has no piece
CACHED, CACHED_CHARS = 400_000, 64  # stretches; their length


def model_path() -> str:
    return public_tokenizers.path(MODEL)


Coded = tuple[bytes, float]  # ids as little-endian 32-bit integers, and the score


class Cache(dict):
    """Asks for what it does not hold."""

    def __init__(self, ask: Callable[[str], Coded]) -> None:
        self.ask = ask

    def __missing__(self, key: str) -> Coded:
        return self.ask(key)


class Codec:
    """Texts to ids and back. A mark in a text decodes to a space, as in the library; all other texts come back as they were."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, self.byte_id, normal = [], {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                normal[piece] = (len(piece), model.get_score(i), i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.single = {p for p in normal if len(p) == 1}
        self.unknown = min((s for _, s, _ in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.whole = any(MARK in p.lstrip(MARK) for p in normal)
        self.automaton = ahocorasick.Automaton()
        for piece, value in normal.items():
            self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.pieces = pa.array([*self.bytes_of, b""], pa.binary())
        self.known = Cache(self.add)
        self.late: list[str] = []

    def segment(self, chunk: str) -> tuple[list[int], float]:
        """Ids and score of the best path; of equal scores, the one whose last piece is longest, at every position.

        The automaton names the pieces that end at a character from the longest to the shortest, so the first of equals stays.
        """
        n = len(chunk)
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(chunk):
            for last, (length, score, i) in self.automaton.iter(chunk):
                end = last + 1
                value = best[end - length] + score
                if value > best[end]:
                    best[end], back[end], piece[end] = value, end - length, i
        else:
            self._relax_with_gaps(chunk, best, back, piece)
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids += [self.byte_id[b] for b in reversed(chunk[back[at] : at].encode())]
            at = back[at]
        ids.reverse()
        return ids, best[n]

    def _relax_with_gaps(self, chunk: str, best: list[float], back: list[int], piece: list[int]) -> None:
        """As in segment(), for text with characters that have no piece: each may be stepped over at the unknown score."""
        gaps = [i + 1 for i, c in enumerate(chunk) if c not in self.single]  # the places behind such characters
        gaps.append(len(chunk) + 1)
        k = 0
        for last, (length, score, i) in self.automaton.iter(chunk):
            while gaps[k] <= last:
                self._bridge(gaps[k], best, back, piece)
                k += 1
            value = best[last + 1 - length] + score
            if value > best[last + 1]:
                best[last + 1], back[last + 1], piece[last + 1] = value, last + 1 - length, i
        for gap in gaps[k:-1]:
            self._bridge(gap, best, back, piece)

    def _bridge(self, gap: int, best: list[float], back: list[int], piece: list[int]) -> None:
        if best[gap - 1] + self.unknown > best[gap]:
            best[gap], back[gap], piece[gap] = best[gap - 1] + self.unknown, gap - 1, -1

    def add(self, key: str) -> Coded:
        """Ids and score of a stretch that is not in the cache. The cache keeps what came first, as frequent words come early; later
        entries last for a block."""
        ids, score = self.segment(key if key[:1] == MARK else MARK + key)
        if len(self.known) >= CACHED or len(key) > CACHED_CHARS:
            self.late.append(key)
        coded = self.known[key] = (array("i", ids).tobytes(), score)
        return coded

    def chunks(self, text: str) -> list[str]:
        """Stretches of any text, each with the marks before it; those of a regular text are its words, without their one mark."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.whole else STRETCH.findall(marked)

    def encode_many(self, texts: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids and score of each text. Every stretch is looked up once a block of texts, however often it occurs there."""
        # regular: words with single spaces between them
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False) | self.whole
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        other = pa.array([self.chunks(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in (split, other)]).astype(np.int64)
        coded = pa.concat_arrays([split.flatten(), other.flatten()]).dictionary_encode()
        known = list(map(self.known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        found = [ids for ids, _ in known]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        scores = np.fromiter((score for _, score in known), float, len(found))
        for key in self.late:
            del self.known[key]
        self.late.clear()
        at = coded.indices.to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(ends(lengths), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
        rows, words = ends(sizes), ends(lengths[at])
        ids = pa.ListArray.from_arrays(pa.array(words[rows], pa.int32()), lists.take(coded.indices).flatten())
        totals = np.array([scores[at[x:y]].sum() for x, y in zip(rows, rows[1:], strict=False)], float)
        order = np.argsort(np.argsort(odd, kind="stable"), kind="stable")  # where each text is among the regular and then the others
        return ids.take(pa.array(order)), totals[order]

    def encode(self, text: str) -> Coded:
        """Ids and score of one text; an empty text has none."""
        ids, scores = self.encode_many(pa.array([text], pa.string()))
        return ids.flatten().to_numpy().astype("<i4").tobytes(), float(scores[0])

    def decode_many(self, ids: pa.ListArray) -> list[str | None]:
        """Texts of lists of ids, without the space that encoding puts first; bytes that are no UTF-8 become U+FFFD, unknown ids
        nothing. A null list gives null."""
        n = len(self.bytes_of)
        values = ids.values.fill_null(n).to_numpy()
        known = np.where((values >= 0) & (values < n), values, n)
        pieces = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()), self.pieces.take(pa.array(known)))
        texts = [None if t is None else t.decode("utf-8", "replace") for t in pc.binary_join(pieces, b"").to_pylist()]
        return [None if null else t.removeprefix(" ") for t, null in zip(texts, ids.is_null().to_pylist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(pa.array([ids], pa.list_(pa.int32())))[0]


def ends(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sum: where each of several stretches in a row begins and ends."""
    return np.concatenate([[0], np.cumsum(sizes)])


def blocks(texts: pa.StringArray) -> list[slice]:
    """Cuts an array into runs of about BLOCK bytes, at least one text each."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK, prepend=-1))
    return [slice(x, y) for x, y in zip(edges, np.append(edges, len(sizes))[1:], strict=True)]


@cache
def codec(path: str) -> Codec:
    """One codec a Python worker."""
    return Codec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, ids (array of int), score. A null or empty text has no ids and score 0."""
    path = model or model_path()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        found = [codec(path).encode_many(texts[cut]) for cut in blocks(texts)] or [codec(path).encode_many(texts)]
        ids, scores = pa.concat_arrays([i for i, _ in found]), np.concatenate([s for _, s in found])
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(scores)], ["doc_id", "ids", "score"])

    return over_texts(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), rows, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (doc_id, ids, score) and its text. Null ids give a null text."""
    path = model or model_path()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array(codec(path).decode_many(batch.column(1)), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "score", "text"])

    return over_texts(encoded.select("doc_id", "ids", "score"), rows, "doc_id long, ids array<int>, score double, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids, score and the text that decoding gives back."""
    return decode(encode(docs, id_col, text_col, model), model)
