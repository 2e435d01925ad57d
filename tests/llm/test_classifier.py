import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from emberloom.llm import classifier

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in classifier.score_documents(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == docs.count()
    known = [r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["doc_id"] in got]
    out = [(got[r["doc_id"]], r["quality"]) for r in known if got[r["doc_id"]].held_out]
    y = np.array([q for _, q in out])
    assert auc(np.array([r.score for r, _ in out]), y) > 0.97
    assert np.mean([r.predicted == q for r, q in out]) > 0.95
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    held = [d for d in ids if zlib.crc32(str(d).encode()) % 5 == 0]
    free = [(d, d % 2) for d in ids if d not in held]
    score = lambda extra: sorted((r.doc_id, r.score) for r in classifier.score_documents(docs, spark.createDataFrame(free + extra, "doc_id long, quality int")).collect())
    assert score([(d, 1) for d in held]) == score([(d, 0) for d in held])


def test_interactions_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = classifier.fit(x, y, rounds=20)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


def test_no_labels_one_kind_and_no_rows(spark, docs, none):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.score_documents(docs, nothing).collect()} == {0.5}
    ones = spark.createDataFrame([(d, 1) for d in range(211)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in classifier.score_documents(docs, ones).collect())
    assert classifier.score_documents(none, nothing).count() == 0


def test_scores_are_those_of_a_plain_reading_of_the_tables(spark, docs):
    """Each feature of a text by hand, its bin by counting edges, and the tables' values added one by one."""
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(211)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    assert model.pairs
    got = {(r.doc_id, r.text): r.score for r in classifier.score_documents(docs, labels).collect()}
    ratio = lambda a, b: a / b if b else 0.0
    for (_, text), score in got.items():
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        chars = sum(map(len, w))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        count = lambda s: sum(t.count(x) for x in s)  # noqa: B023, E731
        x = [
            math.log1p(len(w)), ratio(chars, len(w)), ratio(count("#*$%&<>"), chars), ratio(sum(c.isupper() for c in t), chars), ratio(count("|"), len(w)), ratio(len(set(w)), len(w)),
            ratio(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), ratio(len(lines) - len(set(lines)), len(lines)), ratio(count("!"), len(w)), ratio(count("0123456789"), chars),
            math.log1p(ratio(len(w), len(lines))), ratio(count(".?"), len(w)),
        ]
        z = model.intercept
        for value, edges, table in zip(x, model.edges, model.main, strict=True):
            z += table[sum(e <= value for e in edges)]
        for (i, j), table in zip(model.pairs, model.tables, strict=True):
            z += table[sum(e <= x[i] for e in model.coarse[i]), sum(e <= x[j] for e in model.coarse[j])]
        assert abs(1 / (1 + math.exp(-z)) - score) < 1e-9


def test_contradicting_labels_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a text"), (1, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, 7), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classifier.score_documents(docs, labels).collect()}
    assert len(got) == 3 and not got[None].held_out and len({r.score for r in got.values()}) == 1 and got[1].score > 0.5
