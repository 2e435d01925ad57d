import hashlib
import random

import numpy as np
import pytest

from emberloom.llm import suffix_array as sa
from emberloom.llm import suffix_dedup
from emberloom.llm.suffix_array import shared_prefixes, suffix_array
from tests.llm.conftest import words


@pytest.mark.parametrize("most", [0, 2048])
def test_suffix_array_is_sorted(monkeypatch, most):
    monkeypatch.setattr(sa, "MOST_BUCKETS", most)
    rng = random.Random(most)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 250])
        s = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffix_array(np.array(s), k + 1).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


def test_shared_prefixes():
    texts = [b"banana", b"bandana", b"anan"]
    s = np.array([c + 2 for t in texts for c in (*t, -1)] + [0])
    order = suffix_array(s, 258)
    starts = np.array([0, 7, 15])
    plcp = shared_prefixes(s, order, starts, np.array([6, 7, 4]), 1, 100)
    for a, b in zip(order, order[1:], strict=False):
        if s[b] > 1:
            n = 0
            while s[a + n] == s[b + n] and s[a + n] > 1:
                n += 1
            assert plcp[b] == n


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def same(df, rows):
    want = brute(rows)
    got = suffix_dedup.dedup(df).collect()
    assert sorted(tuple(r[:5]) for r in got) == sorted((d, *want[d]) for d, _ in rows)
    assert all(hashlib.sha256(r.clean).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("hot", [1, 2000])
def test_removed_bytes_are_those_of_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    same(docs, [(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_periodic_texts_and_edges(spark, monkeypatch, broadcast):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    rows = [(k, "a" * rng.choice([99, 100, 101, 150, 400])) for k in range(6)] + [(10 + k, "ab" * 80 + "é" * k) for k in range(5)] + [(20, None), (21, "")]
    rows += [(30 + k, "".join(rng.choice("xy") for _ in range(300)) + "q" * 130) for k in range(4)]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_pieces_of_a_long_text_overlap(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    rows = [(1, long), (2, long[700:1400]), (3, "zz" + long[450:620]), (4, long + "!")]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_null_and_torn_ids(spark):
    p = "The quick brown fox jumps over the lazy dog and runs along the river bank until the sun goes down again, slowly."
    rows = [(None, p + "#a"), (5, p), (5, p + " other"), (7, "short")]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert removed[(None, len(p) + 2)] == len(p) and removed[(7, 5)] == 0
    assert sorted(removed[(5, len(x))] > 0 for x in (p, p + " other")) == [False, True]


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_no_suffix_array_holds_a_common_passage(spark, monkeypatch, broadcast):
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "WIDE", 20)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 40)
    monkeypatch.setattr(suffix_dedup, "SALTS", 3)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(150)
    rows = [(k, some(rng.randint(0, 200)) + passage + some(200)) for k in range(300)]
    rows += [(400 + k, passage[: 100 + k] + some(80)) for k in range(30)] + [(500, passage * 3)] * 2
    taken, wide = suffix_dedup.later_windows, []
    monkeypatch.setattr(suffix_dedup, "later_windows", lambda df: wide.append(df.groupBy("g").count().agg({"count": "max"}).first()[0]) or taken(df))
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert wide and wide[0] > 100


def test_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 40)
    monkeypatch.setattr(suffix_dedup, "SALTS", 2)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    texts = [passage + f" {k} " + "".join(rng.choice("xyz") for _ in range(60)) for k in range(40)] + [passage] * 5
    got = suffix_dedup.dedup(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    # one text keeps the passage; of equal texts all but the first are copies, which without an id all rows alike are not
    whole = [r for r in got if r.n_removed == 0]
    assert len(got) == 45 and len({bytes(r.clean) for r in whole}) == 1
    assert all(r.n_removed in (0, 120, 121, 122, 123) for r in got)


def test_windows_that_no_other_entry_has_are_left_out():
    rng = random.Random(2)
    anchor = bytes(rng.randrange(97, 105) for _ in range(suffix_dedup.ANCHOR))
    some = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    left, right = some(64), some(64)
    entries = []
    for k in range(40):
        i, j = rng.randint(0, 64), rng.randint(0, 64)
        t = (some(64)[: 64 - i] + left[64 - i :])[-rng.randint(0, 64) or 64 :] + anchor
        q = len(t) - len(anchor)
        t += (right[:j] + some(64 - j))[: rng.randint(64 - q, 64)]
        if len(t) >= 100:
            entries.append((1, k, 0, len(t) - 99, k, 0, 0, t, q))
    assert len(entries) > 10
    every = {}
    for e in entries:
        for x in range(e[3]):
            every.setdefault(e[7][x : x + 100], []).append((e[1], x))
    kept = {(e[1], e[2] + x) for e in suffix_dedup.narrowed(entries) for x in range(e[3])}
    for places in every.values():
        if len(places) > 1:
            assert kept.issuperset(places)
    assert len(kept) < sum(e[3] for e in entries)


def test_clean_documents_keep_their_other_columns(docs, rows, none):
    got = suffix_dedup.clean_documents(docs)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["text"] and got.count() == len(rows)
    assert suffix_dedup.clean_documents(none).count() == 0 and suffix_dedup.dedup(none).count() == 0


def test_a_row_repeated_many_times_is_one_document(spark):
    """All copies of a row come out as one of them does, and what is looked at is one row."""
    rng = random.Random(12)
    base = words(rng, 60, 400)
    rows = [(5, base + " tail one")] * 400 + [(9, "head two " + base), (None, base + " tail one"), (5, "another text under the same id " + base), (2, "short")] + [(None, base + " alone")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    base_rows, found = suffix_dedup.marks(df)
    assert base_rows.filter("alike").count() == 430 and found.groupBy("d", "tie").count().filter("count > 1").count() == 0
    got = {}
    for r in suffix_dedup.dedup(df).collect():
        got.setdefault((r.doc_id, r.n_bytes), set()).add((r.n_removed, r.n_spans, r.kept_sha256))
    once = {}
    for r in suffix_dedup.dedup(spark.createDataFrame(sorted(set(rows), key=str), "doc_id long, text string")).collect():
        once.setdefault((r.doc_id, r.n_bytes), set()).add((r.n_removed, r.n_spans, r.kept_sha256))
    assert got == once and all(len(v) == 1 for v in got.values()) and suffix_dedup.dedup(df).count() == len(rows)
