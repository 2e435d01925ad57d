import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    from emberloom.llm.classifier import score_documents
    from tests.llm.test_simhash import brute as classes
    from tests.llm.test_suffix_dedup import brute as repeats

    docs = corpus_pipeline.table(spark, SF, "documents")
    n = docs.count()
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    good = stage[names[0]](spark, docs, SF).cache()
    want = {r.doc_id for r in score_documents(docs, corpus_pipeline.table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and 0 < len(want) < n

    single = stage[names[1]](spark, good, SF).cache()
    found = classes([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in found if d == c}

    clean = stage[names[2]](spark, single, SF).cache()
    want = repeats([(r.doc_id, r.text) for r in single.collect()])
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and len(before[r.doc_id].encode()) - len(r.text.encode()) - want[r.doc_id][1] in range(8 * want[r.doc_id][2] + 1)
    assert clean.count() == single.count()

    mixed = stage[names[3]](spark, clean, SF).cache()
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert words(mixed) == pytest.approx(1.5 * words(clean), rel=0.05)
    for df in (good, single, clean, mixed):
        assert df.columns == corpus_pipeline.COLUMNS

    last = stage[names[4]](spark, mixed, SF)
    assert last.filter("lossless").count() == mixed.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_pieces", "lossless"] and out.count() > 0


def test_no_documents(spark):
    docs = corpus_pipeline.table(spark, SF, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
