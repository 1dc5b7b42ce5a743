"""Operators against known answers and plain versions."""

import hashlib
import os
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import binary, codec, hashing
from cairnspark.operators import compare, graph, index, objects, refs, trees
from cairnspark.sources import files
from cairnspark.streaming import reflog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Published digests of "abc".
ABC = {
    "sha1": "a9993e364706816aba3e25717850c26c9cd0d89d",
    "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",
    "sha3-256": "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532",
}


@pytest.mark.parametrize("name", sorted(ABC))
def test_known_digests(spark, name):
    assert one(spark, hashing.digest(name, F.lit("abc").cast("binary"))) == ABC[name]


def test_other_digests(spark):
    for name, want in [("sha384", hashlib.sha384(b"x")), ("sha3-384", hashlib.sha3_384(b"x")), ("sha3-512", hashlib.sha3_512(b"x"))]:
        assert one(spark, hashing.digest(name, F.lit("x").cast("binary"))) == want.hexdigest()
    assert one(spark, hashing.digest("shake128", F.lit("x").cast("binary"))) == hashlib.shake_128(b"x").hexdigest(32)
    assert one(spark, hashing.digest("shake256", F.lit("x").cast("binary"))) == hashlib.shake_256(b"x").hexdigest(64)
    with pytest.raises(ValueError):
        hashing.digest("md6", F.lit("x"))


def test_object_id(spark):
    assert one(spark, hashing.object_id(F.lit("blob"), F.lit("Hello, world!").cast("binary"))) == hashlib.sha256(b"blob 13\0Hello, world!").hexdigest()
    assert one(spark, hashing.object_id(F.lit("tree"), F.lit("").cast("binary"))) == hashlib.sha256(b"tree 0\0").hexdigest()


@pytest.mark.parametrize("base, target", [(b"Hello, world!", b"Hello, there world!"), (b"", b"abc"), (b"abc", b""), (bytes(range(256)) * 40, b"x" * 300 + bytes(range(256)) * 20), (b"a" * 200_000, b"a" * 150_000)])
def test_delta(base, target):
    delta = binary.make_delta(base, target)
    assert binary.apply_delta(base, delta) == target
    with pytest.raises(ValueError):
        binary.apply_delta(base + b"!", delta)


def test_delta_of_a_long_text_is_short():
    base = bytes(97 + i % 26 for i in range(10_000))
    target = bytearray(base)
    target[::100] = b"X" * 100
    assert len(binary.make_delta(base, bytes(target))) < 4000


def test_tree_payloads():
    entry = b"100644 a.txt\0" + bytes(32)
    assert binary.tree_entries(entry) == [{"mode": 0o100644, "name": "a.txt", "oid": "00" * 32}]
    with pytest.raises(ValueError):
        binary.tree_entries(entry[:-1])


def test_advertised_refs(spark):
    line = lambda s: b"%04x" % (len(s) + 4) + s
    data = line(b"# service\n") + b"0000" + line(b"a" * 40 + b" HEAD\0caps\n") + line(b"b" * 64 + b" refs/heads/x\n") + line(b"c" * 10 + b" short\n") + b"0000"
    got = spark.createDataFrame([(data,)], "d binary").select(binary.pkt_refs("d").alias("r")).first()["r"]
    assert [(r["oid"], r["name"]) for r in got] == [("a" * 40, "HEAD"), ("b" * 64, "refs/heads/x")]


def test_filters(spark):
    rows = spark.createDataFrame([("blob", 10, 0), ("blob", 2000, 1), ("tree", 5, 2)], "type string, size long, depth int")
    count = lambda spec: objects.filtered(rows, spec).count()
    assert [count(s) for s in ("blob:none", "blob:limit=1k", "blob:limit=1m", "tree:2", "blob:limit=1k+tree:1")] == [1, 2, 3, 2, 1]
    with pytest.raises(ValueError):
        codec.filter_spec("sparse:x")


def test_lfs_modes(spark):
    text = "version https://git-lfs.github.com/spec/v1\noid {}\nsize {}\n"
    for oid, size, standard, want in [("sha256:" + "a" * 64, 5, True, True), ("sha256:" + "a" * 64, 5, False, False), ("abc", 5, False, True), ("sha256:" + "a" * 64, 0, True, False)]:
        assert one(spark, codec.parse_lfs(F.lit(text.format(oid, size)), standard))["is_lfs"] is want


def test_trees_of_many_levels(spark):
    paths = {"a": "00", "a.b": "01", "a/b/c": "02", "a/b/d/e/f": "03", "z/é": "04"}
    rows = spark.createDataFrame([(p, 0o100644, h * 32) for p, h in paths.items() if p != "a"], "path string, mode int, oid string")

    def plain(prefix):
        names = {}
        for p in [p for p in paths if p != "a" and p.startswith(prefix)]:
            head, _, rest = p[len(prefix) :].partition("/")
            names[head] = plain(prefix + head + "/") if rest else paths[p] * 32
        out = b"".join((b"40000 " if any(p.startswith(prefix + n + "/") for p in paths) else b"100644 ") + n.encode() + b"\0" + bytes.fromhex(o) for n, o in sorted(names.items(), key=lambda x: x[0].encode()))
        return hashlib.sha256(b"tree %d\0" % len(out) + out).hexdigest()

    built, entries = trees.build(rows)
    got = {r["dir"]: r["tree_oid"] for r in built.collect()}
    assert got == {d: plain(d + "/" if d else "") for d in ("", "a", "a/b", "a/b/d", "a/b/d/e", "z")}
    root = built.where("dir = ''").selectExpr("tree_oid AS root", "tree_oid")
    assert {r["path"] for r in trees.expand(root, trees.link(built, entries), 5).collect()} == set(paths) - {"a"}


def test_graph_with_merges(spark):
    rng = random.Random(4)
    n, parents = 60, {}
    for i in range(n):
        parents[i] = rng.sample(range(max(0, i - 8), i), min(i, rng.randrange(0, 3)))
    edges = spark.createDataFrame([(str(c), str(p), k + 1) for c, own in parents.items() for k, p in enumerate(own)], "child string, parent string, nth int")
    above = {}
    for i in range(n):
        above[i] = {i}.union(*(above[p] for p in parents[i]))
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)]
    got = graph.reach(spark.createDataFrame([(str(a), str(d)) for a, d in set(pairs)], "ancestor string, descendant string"), edges).collect()
    assert {(int(r[0]), int(r[1])): r[2] for r in got} == {(a, d): a in above[d] for a, d in pairs}
    level = {}
    for i in range(n):
        level[i] = 1 + max((level[p] for p in parents[i]), default=-1)
    commits = spark.createDataFrame([(str(i),) for i in range(n)], "oid string")
    assert {int(r[0]): r[1] for r in graph.generations(commits, edges).collect()} == level
    heads = spark.createDataFrame([("1", "1"), (None, "2")], "ours string, theirs string")
    assert {(r[0], r[2]) for r in graph.merge_analysis(heads, edges).collect()} == {("1", "UP_TO_DATE"), (None, "UNBORN")}


def test_log_of_every_length(spark):
    edges = spark.createDataFrame([(str(i), str(i - 1), 1) for i in range(1, 40)], "child string, parent string, nth int")
    for limit in (1, 2, 7, 20, 64):
        got = graph.log(spark.createDataFrame([("39",)], "head string"), edges, limit).collect()
        assert sorted((r["depth"], int(r["commit"])) for r in got) == [(k, 39 - k) for k in range(min(limit, 40))]


def test_positions(spark):
    ids = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("oid"))
    got = [r["oid"] for r in objects.positions(ids).orderBy("position").collect()]
    assert got == sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000))


def test_lines(spark):
    for text, want in [("a\nb", ["a", "b"]), ("a\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""])]:
        assert one(spark, compare.lines(F.lit(text))) == want


def test_symbolic_refs(spark):
    rows = [("a", "1", None), ("b", None, "a"), ("c", None, "b"), ("loop", None, "loop"), ("lost", None, "none")]
    got = {r[0]: r[1] for r in refs.resolve(spark.createDataFrame(rows, "name string, oid string, target string")).collect()}
    assert got == {"a": "1", "b": "1", "c": "1", "loop": None, "lost": None}


def test_empty_index(spark):
    empty = spark.createDataFrame([], "path string, stage int, oid string, mode int, size long")
    row = index.stats(empty).first()
    assert row["entries"] == 0 and row["has_conflicts"] is False


def test_call_windows(spark, tmp_path):
    rows = [(f"r{i % 3}", 20 * i, i % 7 == 0) for i in range(900)]
    calls = spark.createDataFrame(rows, "remote string, s long, ok boolean").selectExpr("remote", "timestamp_seconds(s) AS ts", "ok")
    want = {}
    for remote, s, ok in rows:
        n = want.setdefault((remote, s // 60 * 60), [0, 0])
        n[0] += 1
        n[1] += not ok
    plain = lambda df: {(r["remote"], r["m"]): [r["n_calls"], r["n_failed"]] for r in df.selectExpr("*", "unix_seconds(minute) AS m").collect()}
    assert plain(reflog.call_windows(calls)) == want
    calls.write.parquet(f"{tmp_path}/calls.parquet")
    stream = reflog.call_windows(reflog.read_stream(spark, f"file://{tmp_path}/calls.parquet"))
    late = max(s for _, s, _ in rows) - 600
    assert plain(reflog.run_to_end(stream, f"file://{tmp_path}")) == {k: n for k, n in want.items() if k[1] + 60 <= late}
    busy = spark.range(50).selectExpr("'r' AS remote", "timestamp_seconds(id) AS ts", "id % 2 = 0 AS ok")
    assert [(r["over_budget"], r["opens"]) for r in reflog.call_windows(busy).collect()] == [(30, True)]


def test_new_objects_over_batches(spark, tmp_path):
    """Three batches with ids in common, and no state but the table."""
    for k in range(3):
        spark.range(k * 50, k * 50 + 100).selectExpr("cast(id AS string) AS oid", "id % 7 AS size").union(spark.createDataFrame([("0", 0)], "oid string, size long")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/o.parquet")
    stream = spark.readStream.schema("oid string, size long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/o.parquet")
    got = [r["oid"] for r in reflog.new_objects(stream, f"file://{tmp_path}").collect()]
    assert sorted(map(int, got)) == list(range(200))


def test_loose_objects(spark, tmp_path):
    rows = spark.createDataFrame([("blob", bytearray(b"one")), ("blob", bytearray(b"")), ("tag", bytearray(b"\0\n"))], "type string, data binary")
    for r in files.loose_payloads(rows).collect():
        path = tmp_path / "objects" / r["path"]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(r["content"])
    (tmp_path / "objects" / "notes.txt").write_text("no object")
    got = {(r["oid"], r["type"], r["size"], bytes(r["data"])) for r in files.loose_objects(spark, f"{tmp_path}/objects").collect()}
    assert got == {(hashlib.sha256(t + b" %d\0" % len(d) + d).hexdigest(), t.decode(), len(d), d) for t, d in [(b"blob", b"one"), (b"blob", b""), (b"tag", b"\0\n")]}


@pytest.mark.parametrize("width", [20, 32])
def test_pack_indexes(spark, tmp_path, width):
    ids = sorted(hashlib.sha512(str(i).encode()).digest()[:width] for i in range(50))
    fan = b"".join(sum(x[0] <= b for x in ids).to_bytes(4, "big") for b in range(256))
    body = b"\xfftOc" + (2).to_bytes(4, "big") + fan + b"".join(ids) + b"".join(zlib.crc32(x).to_bytes(4, "big") for x in ids) + b"".join((12 + i).to_bytes(4, "big") for i in range(50)) + bytes(2 * width)
    (tmp_path / "p1.idx").write_bytes(body)
    got = sorted((r["pack"], r["oid"], r["crc32"], r["offset"]) for r in files.pack_indexes(spark, str(tmp_path)).collect())
    assert got == [("p1", x.hex(), zlib.crc32(x), 12 + i) for i, x in enumerate(ids)]


def test_ref_files_and_ini(spark, tmp_path):
    for name, text in [("refs/heads/main", "a" * 64 + "\n"), ("HEAD", "ref: refs/heads/main\n")]:
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r["name"], r["oid"], r["target"]) for r in files.ref_files(spark, str(tmp_path)).collect()}
    assert got == {("refs/heads/main", "a" * 64, None), ("HEAD", None, "refs/heads/main")}
    packed = spark.createDataFrame([("# pack-refs",), ("b" * 40 + " refs/tags/v1",), ("^" + "c" * 40,)], "value string")
    assert [tuple(r) for r in files.packed_refs(packed).collect()] == [("refs/tags/v1", "b" * 40)]
    config = spark.createDataFrame([("c", '[core]\n\tbare = false\n[remote "origin"]\r\n url = /srv/x \r\n# no = key\n')], "file string, text string")
    assert [tuple(r) for r in files.remotes(config).collect()] == [("origin", "/srv/x")]
    assert files.ini(config).count() == 2


def test_large_pack_indexes(spark, tmp_path):
    ids = sorted(hashlib.sha256(str(i).encode()).digest() for i in range(5))
    fan = b"".join(sum(x[0] <= b for x in ids).to_bytes(4, "big") for b in range(256))
    places = [12, (1 << 31) + 1, 40, 1 << 31, (1 << 31) - 1]
    large = [(5 << 32) + 7, 3 << 31]
    body = b"\xfftOc" + (2).to_bytes(4, "big") + fan + b"".join(ids) + bytes(20) + b"".join(x.to_bytes(4, "big") for x in places) + b"".join(x.to_bytes(8, "big") for x in large) + bytes(64)
    (tmp_path / "big.idx").write_bytes(body)
    got = {r["oid"]: r["offset"] for r in files.pack_indexes(spark, str(tmp_path)).collect()}
    assert [got[x.hex()] for x in ids] == [12, 3 << 31, 40, (5 << 32) + 7, (1 << 31) - 1]


def test_long_bundle_headers(spark, tmp_path):
    refs = [(f"{i:064x}", f"refs/heads/topic-{i}-" + "x" * 60) for i in range(9000)]
    head = codec.BUNDLE_TITLE + "\n" + "".join(f"{o} {n}\n" for o, n in refs) + "\n"
    assert len(head) > 1 << 20
    (tmp_path / "a.bundle").write_bytes(head.encode() + b"PACK\xff\n\n" + bytes(100))
    assert [(r["oid"], r["name"]) for r in files.bundle_refs(spark, str(tmp_path)).collect()] == refs


def chain(spark, n):
    return spark.range(1, n).selectExpr("concat('c', id) AS child", "concat('c', id - 1) AS parent", "1 AS nth")


def test_long_histories(spark):
    """20,000 commits in a row, with a branch that is merged in the middle and one at the end that is not."""
    n = 20_000
    edges = chain(spark, n).union(spark.createDataFrame([("b1", "c9000", 1), ("b2", "b1", 1), ("c9500", "b2", 2), ("x1", "c15000", 1), ("x2", "x1", 1)], "child string, parent string, nth int"))
    asked = {("c0", "c19999"): True, ("c19999", "c0"): False, ("b1", "c19999"): True, ("b1", "c9400"): False, ("x1", "c19999"): False, ("c15000", "x2"): True, ("c15001", "x2"): False, ("c700", "c701"): True, ("c701", "c700"): False, ("x1", "x1"): True, ("lone", "lone"): True, ("lone", "c5"): False}
    got = graph.reach(spark.createDataFrame(list(asked), "ancestor string, descendant string"), edges).collect()
    assert {(r["ancestor"], r["descendant"]): r["is_ancestor"] for r in got} == asked
    heads = lambda *ids: spark.createDataFrame([(i,) for i in ids], "oid string")
    assert graph.reachable(heads("c19999"), edges).count() == n + 2
    assert graph.reachable(heads("x2", "lone"), edges).count() == 15_001 + 2 + 1 + 2  # b1 and b2 were merged below
    assert {r["oid"] for r in graph.reachable(heads("c2", "b1"), edges.where("child like 'b%' or child in ('c1', 'c2', 'c3')")).collect()} == {"c0", "c1", "c2", "b1", "c9000"}
    level = {r["oid"]: r["generation"] for r in graph.generations(heads("c0", "c9000", "b2", "c9500", "c19999", "x2", "lone"), edges).collect()}
    assert level == {"c0": 0, "c9000": 9000, "b2": 9002, "c9500": 9500, "c19999": 19999, "x2": 15002, "lone": 0}
    assert graph.log(spark.createDataFrame([("c19999",)], "head string"), edges, 15_000).count() == 15_000


def test_cycles_are_errors(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1)], "child string, parent string, nth int")
    with pytest.raises(ValueError):
        graph.generations(spark.createDataFrame([("a",)], "oid string"), edges)
    two = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "child string, parent string, nth int")
    with pytest.raises(ValueError):
        graph.runs(two)


def test_a_directory_of_many_files(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("concat('d/', lpad(id, 6, '0')) AS path", "33188 AS mode", "sha2(cast(id AS string), 256) AS oid")
    want = hashlib.sha256()
    body = b"".join(b"100644 %06d\0" % i + hashlib.sha256(str(i).encode()).digest() for i in range(n))
    want.update(b"tree %d\0" % len(body) + body)
    built = {r["dir"]: (r["tree_oid"], r["n_entries"]) for r in trees.build(rows, 1)[0].collect()}
    assert built["d"] == (want.hexdigest(), n)
    with pytest.raises(ValueError, match="conflicts"):
        trees.build(rows.withColumn("stage", F.lit(2)), 1)


def test_a_chain_of_many_commits(spark):
    n, last, want = 100_000, None, {}
    for i in range(n):
        body = b"h%d\n" % i + (b"parent %s\n" % last.encode() if last else b"") + b"t"
        last = hashlib.sha256(b"commit %d\0" % len(body) + body).hexdigest()
        want[i] = last
    rows = spark.range(n).selectExpr("1 AS chain", "id AS seq", "id AS key", "concat('h', id, '\n') AS head", "'t' AS tail")
    two = rows.union(spark.createDataFrame([(2, 1, -1, "h0\n", "t")], rows.schema))
    got = {r["key"]: r["oid"] for r in graph.chain_ids(two).collect()}
    assert got.pop(-1) == want[0] and got == want


def test_revision_names(spark):
    edges = chain(spark, 10).union(spark.createDataFrame([("c9", "m", 2), ("m", "c3", 1)], "child string, parent string, nth int"))
    edges = edges.selectExpr("repeat(substr(child, -1), 64) AS child", "repeat(substr(parent, -1), 64) AS parent", "nth").replace("m" * 64, "f" * 64)
    i = lambda c: c * 64
    refs_ = spark.createDataFrame([("HEAD", None, "refs/heads/main"), ("refs/heads/main", i("9"), None), ("refs/tags/v1", i("2"), None), ("refs/heads/v1", i("5"), None), ("refs/heads/HEAD", i("0"), None), ("refs/heads/beef", i("4"), None)], "name string, oid string, target string")
    want = {"HEAD": "9", "main": "9", "v1": "5", "refs/tags/v1": "2", "beef": "4", "main~3": "6", "main^": "8", "main^2": "f", "main^2^": "3", "main~2^~1": "5", "main^0": "9", "HEAD~9": "0", "HEAD~10": None, "main^3": None, "nothing": None, i("7"): "7", i("7") + "~7": "0", "v1~0": "5", "main^^": "7", "main~": "8"}
    got = {r["spec"]: r["oid"] for r in refs.rev_parse(spark.createDataFrame([(s,) for s in want], "spec string"), refs_, edges).collect()}
    assert got == {s: c and i(c) for s, c in want.items()}


def test_commits_with_signatures(spark):
    text = "tree t\nparent p\nauthor a\ncommitter c\nencoding latin1\ngpgsig -----BEGIN\n \n abc\n -----END\n\nsubject\n\nbody\n"
    row = one(spark, codec.parse_commit(F.lit(text)))
    assert row["gpg_signature"] == "-----BEGIN\n\nabc\n-----END" and row["encoding"] == "latin1" and row["message"] == "subject\n\nbody\n" and row["parents"] == ["p"]
    lit = lambda k: F.lit(row[k])
    assert one(spark, codec.commit_text(lit("tree"), F.array(F.lit("p")), lit("author"), lit("committer"), lit("message"), lit("encoding"), lit("gpg_signature"))) == text
    plain = one(spark, codec.parse_commit(F.lit("tree t\nauthor a\ncommitter c\n\nm")))
    assert plain["parents"] == [] and plain["encoding"] is None and plain["gpg_signature"] is None


def test_small_functions(spark):
    assert one(spark, codec.crc32_raw(F.lit("hello").cast("binary"))) == 4029829531
    assert [one(spark, codec.is_retryable(F.lit(c))) for c in (-8, -7, -6, -5, 0)] == [True, True, True, False, False]
    assert [one(spark, index.is_valid(F.lit(p))) for p in ("a", "", None)] == [True, False, False]
    delays = [one(spark, codec.backoff_ms(F.lit(n), key=F.lit(f"caller {k}"))) for n in (0, 3, 12) for k in range(5)]
    assert all(base * 0.8 <= d <= base * 1.2 for d, base in zip(delays, [100] * 5 + [800] * 5 + [30_000] * 5, strict=True)) and len(set(delays)) > 10


def test_own_digests(spark):
    hashing.register(spark, "half_sha", lambda data: hashlib.sha256(data).hexdigest()[:32])
    assert spark.sql("SELECT half_sha(cast('abc' AS binary)) AS x").first()["x"] == ABC["sha256"][:32]


def test_index_nth(spark):
    rows = spark.range(1000).selectExpr("concat('d', id % 9, '/', id) AS path", "cast(id % 2 AS int) AS stage", "'x' AS oid", "1 AS mode", "id AS size")
    want = sorted((r["path"], r["stage"]) for r in rows.collect())
    for n in (0, 1, 499, 999):
        assert [(r["path"], r["stage"]) for r in index.nth(rows, n).collect()] == [want[n]]
    assert index.nth(rows, 1000).count() == 0
