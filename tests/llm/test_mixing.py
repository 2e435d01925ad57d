import random
import re
from collections import defaultdict

import pytest

from emberloom.llm.mixing import expand, mix, subset


def aims(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, total, full = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in left}
        for s in over:
            full[s] = 2.0 * sizes[s]
            total -= full[s]
            left.remove(s)
    return full


def test_targets_and_what_is_taken(docs, rows):
    got = mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = aims(sizes)
    for r in got:
        assert r._words == size(r.text) and r._source_size == sizes[r.source] and r._target == pytest.approx(want[r.source])
        assert 0 <= r._copies <= 2
        taken[r.source] += r._words * r._copies
    for s in sizes:
        # the very long document decides how near its own source can come
        assert taken[s] <= want[s] + 1e-6 and want[s] - taken[s] <= max(r._words for r in got if r.source == s)
    assert sorted((r.doc_id, r._copies) for r in got) == sorted((r.doc_id, r._copies) for r in mix(docs.repartition(5)).collect())
    assert expand(mix(docs)).count() == sum(r._copies for r in got)


def test_subset_reaches_the_best_sum():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {a + n * k for a in reach for k in range(c + 1)}
        chosen = subset(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(chosen, counts, strict=True))
        assert sum(n * k for n, k in zip(lengths, chosen, strict=True)) == max(a for a in reach if a <= budget)


def test_subset_with_a_large_budget():
    lengths, counts = list(range(1, 2000)), [50] * 1999
    budget = sum(n * c for n, c in zip(lengths, counts, strict=True)) // 3
    chosen = subset(lengths, counts, budget)
    assert sum(n * k for n, k in zip(lengths, chosen, strict=True)) == budget
    share = [k / 50 for k in chosen]
    assert 0.2 < sum(share) / len(share) < 0.45


def test_empty_table(none):
    assert mix(none).count() == 0


def test_the_search_holds_few_bitsets(monkeypatch):
    """Even lengths and an odd budget never end the search early; what is kept of it doesn't change the choice."""
    from emberloom.llm import mixing

    lengths, counts = list(range(2, 3002, 2)), [3] * 1500
    budget = 40_001
    few = subset(lengths, counts, budget)
    assert sum(n * k for n, k in zip(lengths, few, strict=True)) == 40_000
    monkeypatch.setattr(mixing, "KEPT_STEPS", 1)
    assert subset(lengths, counts, budget) == few


def test_texts_under_one_id_are_drawn_alike(spark):
    rows = [(1, f"word{k} two three", "a") for k in range(60)] + [(2, "b " * 30, "b"), (3, "c " * 40, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draws = [sorted((r.text, r._copies) for r in mix(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert draws[0] == draws[1] == draws[2]
