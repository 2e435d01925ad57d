from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberloom.functions import geo
from emberloom.functions.text import common_subsequence, root_domain, token_set_ratio
from emberloom.operators import enrich

words = st.lists(st.sampled_from("alpha beta gamma delta Epsilon zeta".split()), max_size=6).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_token_set_ratio_is_symmetric_and_bounded(a, b):
    r = token_set_ratio(a, b)
    assert r == token_set_ratio(b, a) and 0 <= r <= 100


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert common_subsequence(a, b) == best[-1][-1]


def test_token_set_ratio_cases():
    assert token_set_ratio("a b c", "c a") == 100 and token_set_ratio("", "a") == 0 and token_set_ratio(None, None) == 0
    assert token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert token_set_ratio("abcd", "abce") == pytest.approx(75.0)
    assert SequenceMatcher  # the standard library's ratio isn't the Indel one


def test_root_domain(spark):
    cases = {"https://www.a.b.example.com:80/x": "example.com:80", "http://host/": "host", "no url": None, "https://User@News.Example.ORG/": "example.org", "ftp://x.y": "x.y", "//host.example.com/x": "example.com", None: None}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, w string").select("u", "w", root_domain(F.col("u")).alias("d")).collect()
    assert all(r.d == r.w for r in got), got


def test_weapons(spark):
    texts = ["An Iskander-M missile", "Iskander-K only", "in Belgrade town", "удар искандер ракетой", "GRAD rockets; grad again", None, "x" * 100 + " tb2 " + "y" * 100]
    got = enrich.extract_weapons(spark.createDataFrame(list(enumerate(texts)), "id long, notes string")).collect()
    assert sorted((r.event_id, r.weapon_key) for r in got) == [(0, "iskander_m"), (3, "iskander_m"), (4, "grad"), (6, "bayraktar_tb2")]
    span = next(r.evidence_span for r in got if r.event_id == 6)
    assert span == "x" * 59 + " tb2 " + "y" * 59


def test_evidence_is_cut_by_characters(spark):
    texts = ["\U0001f600" * 70 + " himars " + "\U0001f680" * 70, "\nhimars\n", "\u00a0\tthe HIMARS\u2003", "HIMARS himars"]
    got = {r.event_id: r.evidence_span for r in enrich.extract_weapons(spark.createDataFrame(list(enumerate(texts)), "id long, notes string")).collect()}
    assert got == {0: "\U0001f600" * 59 + " himars " + "\U0001f680" * 59, 1: "himars", 2: "the HIMARS", 3: "HIMARS himars"}


def test_actors_are_those_of_all_comparisons(spark):
    """Random names and edits of them, long and short, with a word that all have: no match at the limit is lost."""
    import random

    rng = random.Random(12)
    stock = ["Forces", "of", "the", "Military", "Group", "al", "Nusra", "Brigade", "Northern", "Liberation", "Army", "x", "Zü"]
    known = sorted({" ".join(rng.sample(stock, rng.randint(1, 6))) + rng.choice(["", " of the", f" {rng.randrange(5)}"]) for _ in range(70)})
    names = set()
    for k in known:
        for _ in range(3):
            c = list(k)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(c))
                c[i : i + rng.randint(0, 1)] = rng.choice(["", "a", " ", "e"])
            w = "".join(c).split(" ")
            rng.shuffle(w)
            names.add(" ".join(w + rng.choice([[], ["of"], ["Extra", "Words"]])))
    got = {r.name: r.canonical for r in enrich.canonical_actors(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "name string")).collect()}
    assert set(got) == names
    for n in names:
        best = max(((token_set_ratio(n, k), [-ord(c) for c in k], k) for k in known), key=lambda x: x[0])
        top = [k for k in known if token_set_ratio(n, k) == best[0]]
        assert got[n] == (min(top) if best[0] >= 88 else None)


def test_origins(spark):
    rows = [(1, "airstrike", "Ukraine", "Military Forces of Russia (2000-)"), (2, "airstrike", "Russia", "Military Forces of Russia (2000-)"), (3, "riot", "Ukraine", "Military Forces of Russia (2000-)"), (4, "drone_strike", "Iraq", "Police Forces of the United States (2021-) Air Force"), (5, "airstrike", "Iraq", "Rebels"), (6, "airstrike", None, "Military Forces of Iran"), (7, "airstrike", "Iraq", None)]
    got = {r.id: r for r in enrich.infer_origin(spark.createDataFrame(rows, "id long, category string, country string, actor_a string")).collect()}
    assert {k: r.origin_country for k, r in got.items()} == {1: "Russia", 2: None, 3: None, 4: "United States", 5: None, 6: None, 7: None}
    assert got[1].origin_confidence == 0.5 and got[1].origin_lat == 58.0


def test_actors(spark):
    vocabulary = spark.createDataFrame([("Military Forces of Mali (2021-)",), ("Al Shabaab",)], "name string")
    names = spark.createDataFrame([(" Kremlin ",), ("Forces of Mali Military (2021-)",), ("Unknown",), (None,), ("Al Shabab",)], "name string")
    got = {r.name: r.canonical for r in enrich.canonical_actors(names, vocabulary).collect()}
    assert got == {" Kremlin ": "Military Forces of Russia (2000-)", "Forces of Mali Military (2021-)": "Military Forces of Mali (2021-)", "Unknown": None, "Al Shabab": "Al Shabaab"}


@pytest.mark.parametrize("place", [(0.0, 0.0), (89.99, 10.0), (12.0, 179.999), (-45.0, -180.0)])
def test_near_pairs_are_those_of_a_nested_loop(spark, place):
    import random

    rng = random.Random(4)
    rows = [(k, max(-90.0, min(90.0, place[0] + rng.uniform(-0.2, 0.2))), (place[1] + rng.uniform(-0.2, 0.2) + 540) % 360 - 180, rng.randrange(100_000)) for k in range(120)]
    d = spark.createDataFrame(rows, "id long, lat double, lon double, s long").select("id", "lat", "lon", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"))
    got = sorted((r.id, r.o_id) for r in geo.near_pairs(d, d, "o_", 9_000.0, [9_000.0], 7_200, 20_000).select("id", "o_id").collect())
    gap = geo.seconds(F.col("o_t")) - geo.seconds(F.col("t"))
    other = d.select(*[F.col(c).alias(f"o_{c}") for c in d.columns])
    want = d.join(other, gap.between(-7_200, 20_000) & (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= 9_000))
    assert got == sorted((r.id, r.o_id) for r in want.select("id", "o_id").collect()) and len(got) == len(set(got)) > 120
