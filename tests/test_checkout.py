"""Files written from the index and from trees, and packs in captured responses."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from cairnspark.functions.binary import bands, split_bands
from cairnspark.operators import trees
from cairnspark.sources import binary_files, checkout

FILES = [("a.txt", 0o100644, b"a\n"), ("dir/b.sh", 0o100755, b"#!/bin/sh\n"), ("dir/sub/c", 0o100644, b""), ("dir/sub/again", 0o100644, b"a\n")]


def oid(data):
    return hashlib.sha256(b"blob %d\0" % len(data) + data).hexdigest()


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame([(oid(d), d) for d in {d for _, _, d in FILES}], "oid string, data binary")


def index(spark, more=()):
    rows = [(p, 0, oid(d), m, len(d)) for p, m, d in FILES]
    return spark.createDataFrame([*rows, ("a.txt", 2, oid(b"theirs"), 0o100644, 6), *more], "path string, stage int, oid string, mode int, size bigint")


def written(root):
    return sorted((os.path.relpath(os.path.join(d, f), root), open(os.path.join(d, f), "rb").read()) for d, _, fs in os.walk(root) for f in fs)


def test_checkout_index(spark, objects, tmp_path):
    for _ in range(2):  # what is there is written over
        done = checkout.checkout_index(index(spark), objects, str(tmp_path))
        assert tuple(done) == (4, 14, 0, None)
        assert written(tmp_path) == sorted((p, d) for p, _, d in FILES)
    assert all(os.stat(tmp_path / p).st_mode & 0o777 == m & 0o777 for p, m, _ in FILES)


def test_checkout_failures(spark, objects, tmp_path):
    root = tmp_path / "inner"
    more = [("lost", 0, "0" * 64, 0o100644, 1), ("../out", 0, oid(b"a\n"), 0o100644, 2), ("/abs", 0, oid(b"a\n"), 0o100644, 2), ("dir", 0, oid(b"a\n"), 0o100644, 2)]
    done = checkout.checkout_index(index(spark, more[:3]), objects, f"file://{root}", force=True)
    assert (done["n_files"], done["n_failed"], done["error"]) == (4, 3, "../out: invalid path")
    assert [p for p, _ in written(tmp_path)] == sorted(f"inner/{p}" for p, _, _ in FILES)
    with pytest.raises(OSError, match="lost"):
        checkout.checkout_index(index(spark, more[:1]), objects, str(root))
    assert tuple(checkout.checkout_index(index(spark).limit(0), objects, str(root))) == (0, 0, 0, None)


def test_checkout_tree(spark, objects, tmp_path):
    files = index(spark).where("stage = 0").select("path", "mode", "oid")
    built, entries = trees.build(files)
    roots = built.where("dir = ''").select(F.lit("HEAD").alias("root"), "tree_oid")
    done = checkout.checkout_tree(roots, trees.link(built, entries), objects, str(tmp_path), levels=2)
    assert done["n_files"] == 4 and written(tmp_path) == sorted((p, d) for p, _, d in FILES)


def line(payload):
    return b"%04x" % (len(payload) + 4) + payload


def test_responses(spark, tmp_path):
    text = b"hello"
    pack = b"PACK" + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes([1 << 4 | 5]) + zlib.compress(text)
    cut = [line(b"NAK\n"), line(b"\2Counting"), line(b"\1" + pack[:9]), line(b"\2, done"), line(b"\1" + pack[9:]), b"0000"]
    cases = {
        "banded": (b"".join(cut), pack, "Counting, done", ""), "raw": (pack, pack, "", ""), "behind": (line(b"NAK\n") + pack, pack, "", ""),
        "framed": (line(pack), pack, "", ""), "failed": (line(b"\3no such ref"), None, "", "no such ref"), "empty": (b"", None, "", ""),
        "broken": (b"".join(cut[:2]) + b"0fff\1x", None, "Counting", ""), "junk": (b"zzzz", None, "", ""),
    }
    for data, *want in cases.values():
        assert list(bands(data).values()) == want
    for name in ("banded", "raw", "behind", "framed", "failed", "empty"):
        (tmp_path / f"{name}.response").write_bytes(cases[name][0])
    got = sorted((r["file"], r["type"], bytes(r["data"])) for r in binary_files.responses(spark, str(tmp_path)).collect())
    assert [x[0] for x in got] == [f"{n}.response" for n in ("banded", "behind", "framed", "raw")]
    assert {x[1:] for x in got} == {("blob", text)}
    parts = spark.createDataFrame([(cases["banded"][0],), (None,)], "data binary").select(split_bands("data").alias("b")).select("b.*").collect()
    assert bytes(parts[0]["pack"]) == pack and parts[1]["pack"] is None
