"""Readers of binary files against files put together here."""

import hashlib
import zlib

import pytest

from cairnspark.functions.binary import make_delta
from cairnspark.sources import binary_files, files, writers


def head(kind, size):
    out, low, size = [], size & 15, size >> 4
    out.append(kind << 4 | low | (0x80 if size else 0))
    while size:
        out.append(size & 0x7F | (0x80 if size >> 7 else 0))
        size >>= 7
    return bytes(out)


def oid(kind, data):
    return hashlib.sha256(f"{kind} {len(data)}\0".encode() + data).digest()


def back(n):
    out = [n & 0x7F]
    while n := n >> 7:
        n -= 1
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def test_packs(spark, tmp_path):
    base, other = b"line of text\n" * 3000, b"line of text\n" * 2000 + b"end"
    delta = make_delta(base, other)
    parts, at, offsets = [], 12, []
    for kind, extra, data in [(1, b"", base), (6, None, delta), (7, oid("blob", base), delta), (4, b"", b"tag"), (7, bytes(32), delta)]:
        offsets.append(at)
        link = back(at - offsets[0]) if extra is None else extra
        part = head(kind, len(data)) + link + zlib.compress(data)
        parts.append(part)
        at += len(part)
    body = b"PACK" + (2).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + b"".join(parts)
    (tmp_path / "a.pack").write_bytes(body + hashlib.sha256(body).digest())
    got = [(r["pack"], r["nth"], r["offset"], r["type"], r["size"], r["oid"]) for r in binary_files.packs(spark, str(tmp_path)).orderBy("nth").collect()]
    blob = lambda d: ("blob", len(d), oid("blob", d).hex())
    rows = [blob(base), blob(other), blob(other), ("tag", 3, oid("tag", b"tag").hex()), ("ref-delta", None, None)]
    assert got == [("a", i, offsets[i], *row) for i, row in enumerate(rows)]
    (tmp_path / "b.pack").write_bytes(body[:60])
    with pytest.raises(ValueError):
        list(binary_files.pack_entries(body[:60]))
    (tmp_path / "b.pack").unlink()
    outside = spark.createDataFrame([(bytes(32).hex(), "blob", bytearray(base))], "oid string, type string, data binary")
    thin = {r["nth"]: (r["type"], r["size"], r["oid"]) for r in binary_files.packs(spark, str(tmp_path), outside).collect()}
    assert thin == {**{i: row for i, row in enumerate(rows[:4])}, 4: blob(other)}


def test_staging_files(spark, tmp_path):
    entries = [("a.txt", 0, 5), ("dir/é.txt", 2, 7), ("dir/é.txt", 3, 70_000)]
    body = b"DIRC" + (2).to_bytes(4, "big") + len(entries).to_bytes(4, "big")
    for path, stage, size in entries:
        name = path.encode()
        one = b"".join(x.to_bytes(4, "big") for x in (1, 0, 9, 0, 0, 0, 0o100644, 0, 0, size)) + oid("blob", name) + (len(name) | stage << 12).to_bytes(2, "big") + name + b"\0"
        body += one + bytes(-len(one) % 8)
    (tmp_path / "index").write_bytes(body + hashlib.sha256(body).digest())
    got = [tuple(r)[1:] for r in binary_files.staging_files(spark, str(tmp_path)).orderBy("path", "stage").collect()]
    assert got == [(p, s, oid("blob", p.encode()).hex(), 0o100644, n, 9) for p, s, n in entries]


def test_multi_packs(spark, tmp_path):
    ids = sorted(oid("blob", str(i).encode()) for i in range(30))
    fan = b"".join(sum(x[0] <= b for x in ids).to_bytes(4, "big") for b in range(256))
    body = b"MIDX" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(3) + b"\0" + bytes(3) + b"\1" + fan + b"".join(ids) + bytes(i % 2 for i in range(30)) + b"".join((100 + i).to_bytes(4, "big") for i in range(30)) + bytes(32)
    (tmp_path / "m.midx").write_bytes(body)
    got = sorted((r["oid"], r["pack"], r["offset"]) for r in binary_files.multi_packs(spark, str(tmp_path)).collect())
    assert got == [(x.hex(), i % 2, 100 + i) for i, x in enumerate(ids)]


def test_written_packs(spark, tmp_path, monkeypatch):
    """Long chains of deltas, read as whole files and by ranges of a few bytes."""
    monkeypatch.setattr(binary_files, "RANGE", 64)
    texts = [b"line %d\n" % k * 400 for k in range(12)]
    for k in range(1, 12):
        texts[k] = texts[k - 1][:-50] + b"changed %d" % k
    ids = [oid("blob", t).hex() for t in texts]
    rows = [("pack-x", ids[k], "blob", bytearray(make_delta(texts[k - 1], texts[k]) if k else texts[0]), ids[k - 1] if k else None) for k in range(12)] + [("pack-y", oid("tag", b"t").hex(), "tag", bytearray(b"t"), None)]
    index = writers.write_packs(spark.createDataFrame(rows, "pack string, oid string, type string, data binary, base_oid string"), f"file://{tmp_path}")
    want = {("pack-x", i, "blob", t) for i, t in zip(ids, texts, strict=True)} | {("pack-y", oid("tag", b"t").hex(), "tag", b"t")}
    for read in (binary_files.packs, binary_files.indexed_packs):
        assert {(r["pack"], r["oid"], r["type"], bytes(r["data"])) for r in read(spark, str(tmp_path)).collect()} == want
    body = (tmp_path / "pack-x.pack").read_bytes()
    assert hashlib.sha256(body[:-32]).digest() == body[-32:]
    packed = sorted(tuple(r) for r in files.pack_indexes(spark, str(tmp_path)).select("pack", "oid", "crc32", "offset").collect())
    assert packed == sorted(tuple(r) for r in index.select("pack", "oid", "crc32", "offset").collect())
    places = sorted(r[3] for r in packed if r[0] == "pack-x") + [len(body) - 32]
    assert {r[3]: r[2] for r in packed if r[0] == "pack-x"} == {a: zlib.crc32(body[a:b]) for a, b in zip(places, places[1:], strict=False)}
    idx = (tmp_path / "pack-x.idx").read_bytes()
    assert idx[-64:-32] == body[-32:] and hashlib.sha256(idx[:-32]).digest() == idx[-32:]


def test_staging_ids_of_other_widths():
    name = b"a"
    one = b"".join(x.to_bytes(4, "big") for x in (0,) * 6 + (0o100644, 0, 0, 5)) + bytes(range(20)) + (1).to_bytes(2, "big") + name
    body = b"DIRC" + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + one + bytes(8 - len(one) % 8)
    assert binary_files.staged(body, 20) == [("a", 0, bytes(range(20)).hex(), 0o100644, 5, 0)]


def test_working_files(spark, tmp_path):
    for path in ("a.txt", "dir/é.txt", ".git/HEAD", "dir/.git/index", "build/x.o", "dir/build-linux/y.o", "builder/z", "dir/build"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    want = {(p, len(p.encode()), p.encode()) for p in ("a.txt", "dir/é.txt", "builder/z", "dir/build")}
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        assert {(r["path"], r["size"], bytes(r["data"])) for r in files.working_files(spark, root).collect()} == want


def test_commit_graph_files(spark, tmp_path):
    rows = [(0, "0a" * 32, None, None, 0, 5), (1, "7b" * 32, 0, None, 1, 1 << 33), (2, "ff" * 32, 1, 0, 2, 7)]
    frame = spark.createDataFrame(rows, "position long, oid string, parent1 long, parent2 long, generation int, commit_time long")
    writers.write_commit_graph(frame, f"file://{tmp_path}")
    body = (tmp_path / "commit-graph").read_bytes()
    assert body[:8] == b"CGPH\1\1\0\0" and len(body) == 8 + 1024 + 3 * 52 + 32 and body[8 + 4 * 0x7B : 12 + 4 * 0x7B] == (2).to_bytes(4, "big")
    assert [tuple(r)[1:] for r in binary_files.commit_graphs(spark, str(tmp_path)).orderBy("position").collect()] == rows
