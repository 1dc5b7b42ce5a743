"""What queries write and hold, beside what they answer."""

import datetime
import hashlib
import os
import zlib

from pyspark.sql import functions as F
from pyspark.sql.window import Window

import duckdb
import pytest

from cairnspark.functions.binary import LINE, bands, multiplexed
from cairnspark.operators import graph, packs, refs, sync
from cairnspark.plans import catalog
from cairnspark.sources import binary_files, files, writers


def test_pairs_with_a_descendant_share_its_walk(spark, monkeypatch):
    """A ladder of merges, 30 runs high: 60 pairs below one commit cost one walk and not 60."""
    rows = [(3 * i + k, p, n) for i in range(1, 15) for k, p, n in ((0, 3 * i - 1, 1), (1, 3 * i - 1, 1), (2, 3 * i, 1), (2, 3 * i + 1, 2))]
    edges = spark.createDataFrame(rows, "child bigint, parent bigint, nth int")
    written, plain = [], graph.cut

    def cut(df, name="table"):
        out = plain(df, name)
        if name in ("frontier", "seen"):
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    pairs = spark.range(2, 45).select(F.col("id").alias("ancestor"), F.lit(44).cast("bigint").alias("descendant"))
    got = {r["ancestor"]: r["is_ancestor"] for r in graph.reach(pairs, edges).collect()}
    assert got == dict.fromkeys(range(2, 45), True)
    assert sum(written) < 200


def test_walks_over_numbers(spark):
    edges = spark.range(1, 9).selectExpr("id AS child", "id - 1 AS parent", "1 AS nth")
    heads = spark.createDataFrame([("a", 2, 5), ("b", 5, 2), ("c", None, 3)], "name string, ours bigint, theirs bigint")
    assert {tuple(r) for r in graph.fast_forward(heads, edges).collect()} == {("a", 5, True), ("b", 5, False), ("c", 3, True)}
    named = lambda *x: spark.createDataFrame([(f"refs/heads/{n}", o) for n, o in x], "name string, oid bigint")
    none = edges.selectExpr("child AS oid")
    after = sync.push(none, named(("a", 5), ("b", 2), ("c", 7)), none.limit(0), named(("a", 2), ("b", 5)), edges)[1]
    assert {tuple(r) for r in after.collect()} == {("refs/heads/a", 5, True), ("refs/heads/b", 5, False), ("refs/heads/c", 7, True)}


def test_files_are_written_and_read_by_ranges(spark, tmp_path, monkeypatch):
    """No task sees all rows of an index file, whether it is written or read."""
    root = f"file://{tmp_path}"
    monkeypatch.setattr(files, "RECORDS", 1000)
    monkeypatch.setattr(files, "SMALL", 300)
    rows = spark.range(10_000).select(F.lit("p").alias("pack"), F.sha2(F.col("id").cast("string"), 256).alias("oid"), (F.col("id") % 97).alias("crc32"), (F.col("id") * (1 << 19)).alias("offset"))
    writers.write_pack_indexes(rows, spark.createDataFrame([("p", "00" * 32)], "pack string, digest string"), root)
    writers.write_multi_pack(rows.withColumn("offset", F.col("crc32")), root)
    want = {tuple(r) for r in rows.collect()}
    index, multi = files.pack_indexes(spark, root), binary_files.multi_packs(spark, root)
    assert {(r["pack"], r["oid"], r["crc32"], r["offset"]) for r in index.collect()} == want
    assert {(r["oid"], r["pack"], r["offset"]) for r in multi.collect()} == {(o, 0, c) for _, o, c, _ in want}
    body = (tmp_path / "p.idx").read_bytes()
    assert hashlib.sha256(body[:-32]).digest() == body[-32:]
    assert sorted(os.listdir(tmp_path)) == ["multi.midx", "p.idx"]
    for got in (index, multi):
        at = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(at) > 1 and max(r["count"] for r in at) < 10_000
    graph_ = rows.withColumns({"position": F.row_number().over(Window.orderBy("oid")) - 1, "generation": F.lit(3), "commit_time": F.lit(1 << 40), "parent1": F.when(F.col("crc32") > 5, F.col("crc32")), "parent2": F.lit(None).cast("bigint")})
    columns = ["position", "oid", "parent1", "parent2", "generation", "commit_time"]
    writers.write_commit_graph(graph_.select(*columns), root)
    assert {tuple(r) for r in binary_files.commit_graphs(spark, root).select(*columns).collect()} == {tuple(r) for r in graph_.select(*columns).collect()}


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Names do not pass through the driver's file index."""
    monkeypatch.setattr(files, "binary_files", None)
    for name, line in (("refs/heads/a b/50%25#x", "a" * 64), ("refs/tags/v", "b" * 64), ("HEAD", "ref: refs/heads/m"), ("refs/heads/.lock", "c" * 64), ("other", "d")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(line + "\n")
    for root in (f"file://{tmp_path}", str(tmp_path)):
        got = {(r["name"], r["oid"], r["target"]) for r in files.ref_files(spark, root).collect()}
        assert got == {("refs/heads/a b/50%25#x", "a" * 64, None), ("refs/tags/v", "b" * 64, None), ("HEAD", None, "refs/heads/m")}
        assert {r["path"] for r in files.working_files(spark, root).collect()} == {"refs/heads/a b/50%25#x", "refs/tags/v", "HEAD", "other"}


def test_packs_are_read_in_pieces():
    """However a pack is cut up, with a header before it or in lines of a channel, its entries are the same."""
    texts = [b"", b"a" * 5000, os.urandom(70_000)]
    entry = lambda x: bytes([0x80 | 1 << 4 | len(x) & 15]) + bytes([len(x) >> 4 & 0x7F | 0x80, len(x) >> 11 & 0x7F]) + zlib.compress(x)
    pack = b"PACK" + (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(map(entry, texts)) + bytes(32)
    lines = b"0008NAK\n" + b"".join(b"%04x\1" % (len(x) + 5) + x + b"0007\2go" for x in (pack[i : i + 999] for i in range(0, len(pack), 999))) + b"0000"
    want = list(binary_files.pack_entries(pack))
    assert [x[-1] for x in want] == texts
    for n in (1, 7, 4096):
        cut = lambda x: iter([x[i : i + n] for i in range(0, len(x), n)])
        assert list(binary_files.pack_entries(cut(pack))) == want
        assert list(binary_files.pack_entries(binary_files.behind_header(cut(b"# v2\nref\n\n" + pack)))) == want
        for response in (lines, pack, b"0008NAK\n" + pack, b"0008NAK\n00", b""):
            assert b"".join(binary_files.pack_band(cut(response))) == (bands(response)["pack"] or b"")
        assert list(binary_files.pack_entries(binary_files.pack_band(cut(lines)))) == want


def test_a_name_is_looked_up_once(spark, monkeypatch):
    """Specs are not multiplied by the forms that a name may have."""
    plans, plain = [], refs.cut
    monkeypatch.setattr(refs, "cut", lambda df, name="table": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    known = spark.createDataFrame([("refs/heads/m", "1" * 64, None), ("refs/tags/m", "2" * 64, None), ("m", "3" * 64, None)], "name string, oid string, target string")
    specs = spark.createDataFrame([("m",), ("refs/tags/m",), ("heads/m",), ("4" * 64,), ("m^",)], "spec string")
    edges = spark.createDataFrame([("1" * 64, "5" * 64, 1)], "child string, parent string, nth int")
    got = {r["spec"]: r["oid"] and r["oid"][0] for r in refs.rev_parse(specs, known, edges).collect()}
    assert got == {"m": "1", "refs/tags/m": "2", "heads/m": None, "4" * 64: "4", "m^": "5"}
    assert not any("posexplode" in p for p in plans)


def moved(spark, df) -> int:
    """Bytes that the jobs of df shuffle."""
    context, group = spark.sparkContext, f"moved-{os.urandom(8).hex()}"
    context.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("name, most", [("midx_lookup", 100), ("pack_lookup", 100), ("pack_order", 120)])
def test_digests_are_not_moved(spark, name, most):
    """Bytes shuffled a line item: its id is a digest of 64 digits, which do not compress, and is made of its keys where rows have met."""
    sf = "/root/testdata/sf0.01"
    assert moved(spark, catalog.QUERIES[name](spark, sf)) < most * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_positions_of_ids_made_late(spark):
    """Equal ids of a pack go by their offsets, whether ids are given or made of something."""
    rows = [(p, str(k), o) for p in ("a", "b") for k in range(300) for o in (k * 7 % 100, 1000 + k)]
    index = spark.createDataFrame(rows, "pack string, oid string, offset bigint").withColumn("oid", (F.col("oid").cast("int") % 200).cast("string"))
    oid = F.sha2("oid", 256)
    made = {tuple(r) for r in packs.order(index, oid).collect()}
    assert made == {tuple(r) for r in packs.order(index.withColumn("oid", oid)).collect()}
    for pack in ("a", "b"):
        own = sorted((hashlib.sha256(str(int(k) % 200).encode()).hexdigest(), o) for p, k, o in rows if p == pack)
        assert sorted((o, at, i) for p, o, at, i in made if p == pack) == sorted((o, at, i) for i, (o, at) in enumerate(own))


@pytest.mark.parametrize("name, most", [("pack_lookup", 70), ("midx_lookup", 74)])
def test_what_follows_from_keys_is_not_moved(spark, name, most):
    """Bytes shuffled a line item where no table is small enough to be broadcast: sizes, buckets and text are made of keys that are moved anyway."""
    sf, threshold = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, -1)
    try:
        assert moved(spark, catalog.QUERIES[name](spark, sf)) < most * spark.read.parquet(f"{sf}/lineitem.parquet").count()
    finally:
        spark.conf.unset(threshold)


def test_items_without_a_month_or_a_key_are_looked_up(spark, tmp_path):
    """Packs without a name are packs, and items without an id take their place in one."""
    month = lambda k: None if k % 5 == 0 else datetime.datetime(2020, 1 + k % 3, 1)
    items = [(None if k % 11 == 0 else k * 100, None if k % 13 == 0 else k % 7, k, 1 + k % 4, month(k)) for k in range(1, 400)]
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 400).selectExpr("id * 100 AS o_orderkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("pack_lookup", "pack_order"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        assert any(r[got.columns.index("pack")] is None for r in want)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["response_scan", "bundle_scan"])
def test_no_file_is_one_value(spark, name):
    """A value has 2 GB at most, a file any number: none is read whole into a row. Values of files end at 1,000 bytes here."""
    longest = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(longest, 1000)
    try:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 100
    finally:
        spark.conf.unset(longest)


def test_responses_are_written_in_pieces(spark, tmp_path):
    """However a pack comes in, the lines are the same, and they hold the pack that is written as a file of its own."""
    rows = [("p", hashlib.sha256(d).hexdigest(), "blob", bytearray(d)) for d in (os.urandom(70_000), b"", b"a" * 5000, os.urandom(LINE))]
    objects = spark.createDataFrame(rows, "pack string, oid string, type string, data binary")
    writers.write_packs(objects, f"file://{tmp_path}")
    writers.write_responses(objects, f"file://{tmp_path}")
    pack, response = (tmp_path / "p.pack").read_bytes(), (tmp_path / "p.response").read_bytes()
    assert bands(response) == {"pack": pack, "progress": "0\n65515\n131030\n", "error": ""}
    for data in (pack, pack[:LINE], pack[: 2 * LINE], b""):
        whole = b"".join(multiplexed(iter([data])))
        assert (bands(whole)["pack"] or b"") == data and whole[-4:] == b"0000"
        for n in (4096, LINE, 100_000):
            assert b"".join(multiplexed(iter([data[i : i + n] for i in range(0, len(data), n)]))) == whole
    assert b"".join(multiplexed(iter([pack]))) == response


def test_indexes_are_written_from_rows_dealt_out_once(spark):
    """Bytes shuffled a line item until an index is written and read: columns are told apart by the tasks that write them, and digests are made there."""
    context, group, sf = spark.sparkContext, f"indexes-{os.urandom(8).hex()}", "/root/testdata/sf0.01"
    context.setJobGroup(group, group)
    catalog.QUERIES["idx_scan"](spark, sf).write.format("noop").mode("overwrite").save()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    ids = {s for job in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(job).stageIds}
    kept = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
    ran = [s for s in map(kept.apply, range(kept.size())) if s.stageId() in ids]  # stages that were skipped moved nothing
    assert 0 < sum(s.shuffleWriteBytes() for s in ran) < 120 * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_places_of_large_offsets(spark, tmp_path):
    """They count on from one task's rows to the next, in each index of its own; equal ids keep their own offsets, and rows without an id are an error."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("pack"), F.sha2((F.col("id") % 5500).cast("string"), 256).alias("oid"),
        (F.col("id") * 714_000 % (1 << 32)).alias("crc32"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.col("id") * (1 << 21)).alias("offset"),
    )
    ends = spark.createDataFrame([("a", "0a" * 32), ("b", "0b" * 32)], "pack string, digest string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report = {r["file"]: r for r in writers.write_pack_indexes(rows, ends, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(os.listdir(tmp_path)) == ["a.idx", "b.idx"]
    want = [tuple(r) for r in rows.collect()]
    assert sorted(tuple(r) for r in files.pack_indexes(spark, str(tmp_path)).select("pack", "oid", "crc32", "offset").collect()) == sorted(want)
    for pack in "ab":
        body, own = (tmp_path / f"{pack}.idx").read_bytes(), sorted((bytes.fromhex(o), at) for p, o, _, at in want if p == pack)
        n, large = len(own), [at for _, at in own if at >= 1 << 31]
        assert body[8:1032] == b"".join(sum(o[0] <= b for o, _ in own).to_bytes(4, "big") for b in range(256))
        assert body[1032 : 1032 + 32 * n] == b"".join(o for o, _ in own)
        nth = iter(range(1 << 31, 1 << 32))
        assert body[1032 + 36 * n : 1032 + 40 * n] == b"".join((at if at < 1 << 31 else next(nth)).to_bytes(4, "big") for _, at in own)
        assert body[1032 + 40 * n : -64] == b"".join(at.to_bytes(8, "big") for at in large) and len(large) > 1000
        assert body[-64:-32] == bytes.fromhex(f"0{pack}" * 32) and body[-32:] == hashlib.sha256(body[:-32]).digest()
        assert (report[f"{pack}.idx"]["size"], report[f"{pack}.idx"]["digest"]) == (len(body), body[-32:].hex())
    with pytest.raises(Exception, match="is in no index"):
        writers.write_pack_indexes(rows.withColumn("oid", F.when(F.col("offset") > 0, F.col("oid"))), ends, f"file://{tmp_path}/other")


def test_headers_of_bundles_are_read_alone(spark, tmp_path):
    """Lines up to the first empty one, whatever comes behind it; names are UTF-8, as they are written."""
    oid, title = lambda c: c * 64, "# v2 git bundle\n"
    texts = {
        "a": title + f"{oid('a')} refs/heads/é ü\nno ref\n-{oid('b')} base\n{'c' * 40} refs/tags/{'x' * 70_000}\n\n{oid('d')} behind\n", "b": title + "\n" + f"{oid('e')} behind\n\n",
        "c": f"# other\n{oid('e')} no bundle\n\n", "d": title + f"{oid('f')} refs/heads/last", "e": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.bundle").write_bytes(text.encode() + b"PACK\xff\n\n" * 1000 * (name != "d"))
    got = [(r["file"][-8], r["oid"], r["name"]) for r in files.bundle_refs(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a", oid("a"), "refs/heads/é ü"), ("a", "c" * 40, "refs/tags/" + "x" * 70_000), ("d", oid("f"), "refs/heads/last")]
