import pytest
import xxhash
from pyspark.sql import functions as F

from emberloom.llm import simhash
from emberloom.llm.components import components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(fps))


def test_components_are_those_of_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_links_connect_what_two_bits_connect(spark):
    values = [0, 1, 3, 7, 1 << 62, (1 << 63) - 1, -1, -2, -4, 0b11110000, 0b11111100, 12345]
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    root = {r.node: r.root for r in components(links).collect()}
    mask = (1 << 64) - 1
    near = lambda a, b: ((a ^ b) & mask).bit_count() <= 2
    for a in values:
        for b in values:
            if a != b and near(a, b):
                assert root[a] == root[b]
    assert root[0] == root[7] and root.get(12345) is None


def test_spark_hashes_alike(spark):
    text = "Größe matters HERE"
    got = spark.createDataFrame([(text.lower(),)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("größe matters here".encode()) == got


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_chain_of_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501), (501, 501), (None, 3)], "a long, b long")
    root = {r.node: r.root for r in components(chain).collect()}
    assert {root[k] for k in range(101)} == {0} and root[501] == root[500] == 500


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_chunks_of_shingles_change_nothing(monkeypatch):
    from emberloom.llm import simhash

    texts = [b"a b c d e f g h i j k l m n o p " * 9, b"one", b"one two", b"x y z", b"a b c d e f", b"a b c d e f g"]
    want = [simhash.fingerprint(t) for t in texts]
    for n in (1, 2, 4, 5):
        monkeypatch.setattr(simhash, "CHUNK", n)
        assert [simhash.fingerprint(t) for t in texts] == want
