"""Byte-level BPE ids of whole texts, with a cache of what stands between single spaces."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken

#: The vocabulary as ranks; the same ids as byte_bpe_50k.json gives under `tokenizers`.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
CACHED_PARTS = 400_000


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


class Irregular(Exception):
    """White space other than one space between two parts."""


class Encoder(dict):
    """Maps a part of a text, found between single spaces, to its ids with the space before it, as little-endian 32-bit bytes.

    The pattern that splits texts takes a space before a word into the word, and nothing else crosses that boundary if both
    neighbours of the space are not white space. So such parts are encoded one by one, and most of them from the cache.
    Texts with any other white space at a part's edge are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise Irregular
        ids = self.plain(" " + part)
        if len(self) < CACHED_PARTS:  # the cache keeps what came first: frequent words come early
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and first[-1:].isspace():
            return self.plain(text)
        try:
            return self.plain(first) + b"".join(map(self.__getitem__, rest))
        except Irregular:
            return self.plain(text)


@cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
