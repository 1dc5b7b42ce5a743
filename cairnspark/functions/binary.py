"""Binary codecs in Arrow batches: zlib, deltas, tree payloads. Small helpers; the rows are Spark's."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = 1
BLOCK = 16  # bytes of a base that a delta copies at least


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    """zlib stream at the level of loose objects."""
    return data.map(lambda b: None if b is None else zlib.compress(bytes(b), LEVEL))


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.decompress(bytes(b)))


def varint(n: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 0x80:
            return value, at


def make_delta(base: bytes, target: bytes) -> bytes:
    """Copies of stretches of the base, found by blocks of BLOCK bytes, and what lies between them."""
    where: dict[bytes, int] = {}
    for i in range(0, len(base) - BLOCK + 1, BLOCK):
        where.setdefault(base[i : i + BLOCK], i)
    out, fresh, at = [varint(len(base)), varint(len(target))], bytearray(), 0

    def flush() -> None:
        for i in range(0, len(fresh), 127):
            part = fresh[i : i + 127]
            out.append(bytes([len(part)]) + part)
        fresh.clear()

    while at < len(target):
        start = where.get(target[at : at + BLOCK])
        if start is None:
            fresh.append(target[at])
            at += 1
            continue
        n = BLOCK
        while n < 0xFFFF and at + n < len(target) and start + n < len(base) and target[at + n] == base[start + n]:
            n += 1
        flush()
        op, fields = 0x80, b""
        for bit, value in [*enumerate(start.to_bytes(4, "little")), *enumerate(n.to_bytes(2, "little"), 4)]:
            if value:
                op |= 1 << bit
                fields += bytes([value])
        out.append(bytes([op]) + fields)
        at += n
    flush()
    return b"".join(out)


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target; an error if base or target have another length than the delta says."""
    size, at = read_varint(delta, 0)
    want, at = read_varint(delta, at)
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 0x80:
            fields = []
            for bit in range(7):
                fields.append(delta[at] if op >> bit & 1 else 0)
                at += op >> bit & 1
            start, n = int.from_bytes(fields[:4], "little"), int.from_bytes(fields[4:], "little") or 0x10000
            out += base[start : start + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("reserved delta operation")
    if size != len(base) or want != len(out):
        raise ValueError("delta does not fit its base")
    return bytes(out)


@F.pandas_udf(T.BinaryType())
def delta_compress(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or t is None else make_delta(bytes(b), bytes(t)) for b, t in zip(base, target, strict=True)])


@F.pandas_udf(T.BinaryType())
def delta_apply(base: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or d is None else apply_delta(bytes(b), bytes(d)) for b, d in zip(base, delta, strict=True)])


def tree_entries(data: bytes, width: int = 32) -> list[dict]:
    """Entries of a tree payload, in its order; an error if it breaks off."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\0", at)
        mode, _, name = data[at:end].partition(b" ")
        oid = data[end + 1 : end + 1 + width]
        if len(oid) < width:
            raise ValueError("tree payload breaks off")
        out.append({"mode": int(mode, 8), "name": name.decode(), "oid": oid.hex()})
        at = end + 1 + width
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("mode", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("oid", T.StringType())])))
def parse_tree(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else tree_entries(bytes(b)))


def pkt_payloads(data: bytes) -> list[bytes]:
    """Payloads of pkt-lines up to the end of the data; flushes and delimiters are left out."""
    out, at = [], 0
    while at + 4 <= len(data):
        size = int(data[at : at + 4], 16)
        if size >= 4:
            out.append(data[at + 4 : at + size])
        at += max(size, 4)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("oid", T.StringType()), T.StructField("name", T.StringType())])))
def pkt_refs(data: pd.Series) -> pd.Series:
    """Refs of an advertisement: lines with an id of 40 or 64 hex digits, without what follows a zero byte."""

    def refs(raw: bytes) -> list[dict]:
        out = []
        for line in pkt_payloads(raw):
            oid, _, name = line.split(b"\0")[0].strip().partition(b" ")
            if len(oid) in (40, 64) and not line.startswith(b"# "):
                out.append({"oid": oid.decode(), "name": name.decode()})
        return out

    return data.map(lambda b: None if b is None else refs(bytes(b)))


# Channels of a multiplexed response, by the first byte of a payload.
PACK_BAND, PROGRESS_BAND, ERROR_BAND = 1, 2, 3


def bands(data: bytes) -> dict:
    """What a captured response holds, by channel. A pack may also stand outside pkt-lines, alone or behind them: it goes on to the
    end. No pack gives null; a line that breaks off ends the response."""
    parts: dict[int, list[bytes]] = {PACK_BAND: [], PROGRESS_BAND: [], ERROR_BAND: []}
    at = 0
    while at + 4 <= len(data):
        head = data[at : at + 4]
        if head == b"PACK":
            parts[PACK_BAND].append(data[at:])
            break
        try:
            size = max(int(head, 16), 4)
        except ValueError:
            break
        payload = data[at + 4 : at + size]
        if len(payload) < size - 4:
            break
        if payload[:4] == b"PACK":
            parts[PACK_BAND].append(payload)
        elif payload and payload[0] in parts:
            parts[payload[0]].append(payload[1:])
        at += size
    pack, progress, error = (b"".join(parts[k]) for k in (PACK_BAND, PROGRESS_BAND, ERROR_BAND))
    return {"pack": pack or None, "progress": progress.decode("utf-8", "replace"), "error": error.decode("utf-8", "replace")}


@F.pandas_udf(T.StructType([T.StructField("pack", T.BinaryType()), T.StructField("progress", T.StringType()), T.StructField("error", T.StringType())]))
def split_bands(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bands(b"" if b is None else bytes(b)) for b in data], columns=["pack", "progress", "error"])


LINE = 65_515  # bytes of a multiplexed line at most, its length and channel not counted


def multiplexed(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """A pack, in pieces of any size, as a response carries it: lines of the pack's channel with one of progress before each, and a flush.
    Less than a line is held besides a piece."""
    line = lambda channel, part: b"%04x" % (len(part) + 5) + bytes([channel]) + part
    left, at = b"", 0
    for piece in chain(pieces, [None]):
        left += piece or b""
        whole = len(left) if piece is None else len(left) // LINE * LINE
        for i in range(0, whole, LINE):
            yield line(PROGRESS_BAND, b"%d\n" % (at + i)) + line(PACK_BAND, left[i : min(i + LINE, whole)])
        left, at = left[whole:], at + whole
    yield b"0000"


@F.pandas_udf(T.BinaryType())
def multiplex(pack: pd.Series) -> pd.Series:
    """A pack that is small enough for a value, as multiplexed() gives it."""
    return pack.map(lambda b: None if b is None else b"".join(multiplexed(iter([bytes(b)]))))
