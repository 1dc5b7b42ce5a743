"""Each stage on the rows that the stage before has kept, against a plain version."""

import itertools

import corpus_pipeline
from cairnspark.llm import quality_classifier, secret_scan
from cairnspark.llm.common import keep, table
from test_dedup import brute_components, brute_fingerprint, lowered

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    out, names = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = keep(stage(spark, docs, SF), name)
        out[name] = (before, docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == names
    judged = {r.doc_id: r.predicted for r in quality_classifier.score(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    before, after = out["quality_classifier"]
    assert {r.doc_id for r in after} == {i for i, good in judged.items() if good}
    before, after = out["exact_dedup"]
    last = {}
    for i, r in before.items():
        last[lowered(r.text)] = max(i, last.get(lowered(r.text), i))
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after = out["simhash_near_dedup"]
    prints = {i: brute_fingerprint(r.text) for i, r in before.items()}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert sorted(r.doc_id for r in after) == sorted(set(brute_components(prints, linked).values()))
    before, after = out["secret_scan"]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert r.n_chars == len(r.text) and not secret_scan.base_spans(r.text)
        if not secret_scan.base_spans(before[r.doc_id].text) and "[secret]" not in r.text:
            assert r == before[r.doc_id]
    before, after = out["best_fit_packing"]
    assert {r.doc_id for r in after} == set(before)
    ends = {}
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(r.length for r in after) // 1024) + 3
    assert {r.sequence_id: 0 for r in after}.keys() == {r.sequence_id for r in after if r.offset == 0}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in after}


GOOD = "The committee met in the spring and agreed on the plan that the engineers had drawn up, because it was cheaper than the old one and would last for many years. "


def test_stages_of_odd_tables(spark):
    """Null ids, repeated ids with other texts, nulls in every column, columns named like internal ones; and no rows at all."""
    names = ["row", "digest", "maybe", "keep_id", "group_size", "n_top", "digest__", "good__", "gone__", "__salt", "__hot", "spans", "part", "nth"]
    good, bad = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").where("length(text) > 400").groupBy("quality").agg({"text": "min"}).orderBy("quality", ascending=False).collect()
    n = 10**6
    rows = [(n, good[1] + " a"), (n, bad[1] + " b"), (None, good[1] + " One more sentence."), (None, bad[1] + " x"), (n + 2, None), (n + 3, ""), (None, None), (n + 4, good[1].upper()), (n + 5, "x" * 50_000), (n + 6, GOOD * 3)]
    all_ = spark.createDataFrame(rows, "doc_id long, text string").union(table(spark, SF, "documents").select("doc_id", "text"))
    docs = keep(all_.selectExpr("*", "cast(null AS string) AS lang", *[f"'{c}' AS `{c}`" for c in names]), "odd")
    for rows_ in (docs, docs.where("false")):
        now = rows_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = keep(stage(spark, now, SF), name)
            assert now.columns == docs.columns
            if name == "quality_classifier" and rows_ is docs:
                left = [(r.doc_id, r.text) for r in now.collect()]
                assert rows[0] in left and rows[1] not in left and rows[2] in left and rows[3] not in left
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert bool(packed) == (rows_ is docs)
