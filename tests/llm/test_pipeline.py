from collections import Counter

import corpus_pipeline as P


def test_pipeline_stages(spark, odd_docs):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        kept = {r.doc_id for r in rows}
        assert len(rows) == len(kept) and kept <= ids
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * len(labels)
        if name == "language":
            assert kept == ids
        if name == "near_duplicates":
            by = {r.component_id: 0 for r in P.neardup.near_duplicates(docs, size=5).collect()}
            assert kept == set(by)
        if name == "secrets":
            assert kept == ids and not any('token = "' in r.text and "[SECRET]" not in r.text for r in rows)


def test_stages_take_odd_rows(spark, odd_docs):
    rows = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(null as bigint) AS n_chars")
    sf = "/root/testdata/sf0.001"
    assert Counter(r.doc_id for r in P.drop_near_duplicates(spark, rows, sf).collect()) == Counter([1, 2, 3, 4, 5, 7, 7, None, 9, 10, 11, 12, 13])
    docs = rows
    for _, stage in P.STAGES[:-1]:
        before, docs = Counter(r.doc_id for r in docs.collect()), stage(spark, docs, sf)
        assert docs.columns == rows.columns and not Counter(r.doc_id for r in docs.collect()) - before
    kept = docs.collect()
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert kept and {r.doc_id for r in kept} == {r.doc_id for r in packed} and sum(r.piece == 0 for r in packed) == len(kept)
    empty = rows.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for xs in per.values():
        at = 0
        for o, n in sorted(xs):
            assert o == at
            at += n
        assert at <= 1024


def test_language_stage_judges_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.orderBy("doc_id").first()
    more = [(999999, good.text, good.lang, good.source, 1), (999999, "", good.lang, good.source, 0), (999999, None, good.lang, None, 0), (None, good.text, None, good.source, 1), (None, "", None, None, 0)]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = P.keep_identified(spark, rows, sf)
    assert sorted((r.doc_id or 0, r.text == good.text) for r in kept.where("doc_id = 999999 OR doc_id IS NULL").collect()) == [(0, True), (999999, True)]
    assert kept.count() == docs.count() + 2


def test_stages_keep_both_texts_of_an_id(spark, odd_docs):
    rows = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(null as bigint) AS n_chars")
    sf = "/root/testdata/sf0.001"
    alone = rows.selectExpr("row_number() OVER (ORDER BY doc_id, text) AS doc_id", "doc_id AS was", "text", "lang", "source", "n_chars")
    for name, stage in P.STAGES[:-1]:
        if name != "near_duplicates":  # each row is judged as if it had an id of its own
            want = Counter(r.was for r in stage(spark, alone.drop("was"), sf).join(alone.select("doc_id", "was"), "doc_id").collect())
            assert Counter(r.doc_id for r in stage(spark, rows, sf).collect()) == want and want[7] == 2
