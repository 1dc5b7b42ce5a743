"""Rule statistics of a text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np

WINDOW = 8
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
#: Counts in the order of counts(); FEATURES in the order of features().
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pipes", "n_upper", "n_digits", "n_marks", "n_adjacent", "n_distinct", "n_lines", "n_stops")
FEATURES = ("log_words", "word_length", "symbols", "pipes", "upper", "digits", "marks", "dup_lines", "repeats", "adjacent", "distinct", "stops")
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(1, WINDOW + 1)], np.uint64)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more, all occurrences counted."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = sum(((hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29))) * _MIX[i] for i in range(WINDOW)), np.zeros(n, np.uint64))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    likely = np.zeros(n, bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    at = np.flatnonzero(likely).tolist()
    windows = [b" ".join(words[i : i + WINDOW]) for i in at]
    found = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if found[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8. Words are split at the ASCII white space characters, and there only."""
    words = text.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines = text.split(b"\n")
    worded = [x for x in lines if x.strip(SPACE)]
    one = text.count
    return (
        len(words),
        len(text.decode()) - sum(one(SPACE[i : i + 1]) for i in range(len(SPACE))),
        sum(one(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        len(worded) - len(set(worded)),
        repeated_words(words, hashes),
        one(b"|"),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, DIGITS)),
        one(b"!") + one(b"?"),
        int((hashes[1:] == hashes[:-1]).sum()),
        len(np.unique(hashes)),
        len(worded),
        one(b"."),
    )


def features(count: np.ndarray) -> np.ndarray:
    """FEATURES, one row for each row of counts: shares of words, characters or lines, so that length hardly matters."""
    c = dict(zip(COUNTS, np.asarray(count, float).reshape(-1, len(COUNTS)).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_pipes"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words,
            c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_adjacent"] / words, c["n_distinct"] / words, c["n_stops"] / words,
        ],
        axis=1,
    )
