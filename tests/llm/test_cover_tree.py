import numpy as np
import pyarrow.parquet as pq
import pytest

from emberloom.llm import cover_tree


def brute(vectors, cosine=0.95):
    n = len(vectors)
    good = [i for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for a in good:
        for b in good:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    return [(i, links[i], find(i), find(i) == i) for i in range(n)]


def test_links_and_components_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    monkeypatch.setattr(cover_tree, "CENTRES", 5)
    rng = np.random.default_rng(3)
    v = []
    for b in rng.normal(size=(40, 12)):
        v += [(b + rng.normal(size=12) * rng.choice([0, 0.02, 0.12, 0.25])).tolist() for _ in range(rng.integers(1, 9))]
    v += [v[0]] * 30 + [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [float("inf")] * 12, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, x, 7, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int, n_links int")
    assert sorted(map(tuple, cover_tree.near_duplicates(df).collect())) == brute(v)


def clustered(rng, n, dim, copies):
    x = np.repeat(rng.normal(size=(n, dim)), copies, axis=0)
    x = x + rng.normal(size=x.shape) * rng.choice([1e-9, 0.001, 0.02, 0.1, 0.4], size=len(x))[:, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [1, 2, 5, 24])
def test_the_tree_nests_covers_and_separates(dim):
    rng = np.random.default_rng(dim)
    x = clustered(rng, 40, dim, 12)
    level, parent = cover_tree.nets(x)
    for k in range(int(level.max()) + 1):
        net, radius = np.flatnonzero(level <= k), 2 / 2**k
        gaps = np.sqrt(np.maximum(2 - 2 * x[net] @ x[net].T, 0)) + 9 * np.eye(len(net))
        if k < cover_tree.LEVELS:
            assert gaps.min() > radius - 1e-7
            assert (np.sqrt(np.maximum(2 - 2 * (x @ x[net].T).max(1), 0)) <= radius + 1e-7).all()
        new = np.flatnonzero(level == k) if k else []
        assert all(level[parent[i]] < k and np.sqrt(max(2 - 2 * x[i] @ x[parent[i]], 0)) <= 2 * radius + 1e-7 for i in new)
    tree = cover_tree.CoverTree.loads(cover_tree.CoverTree(x).dumps())
    assert np.array_equal(tree.x, x[tree.order]) and sorted(tree.order) == list(range(len(x)))
    for i in range(len(tree.centre)):
        own = tree.x[tree.begin[i] : tree.end[i]]
        assert np.sqrt(np.maximum(2 - 2 * own @ tree.x[tree.centre[i]], 0)).max() <= tree.radius[i] + 1e-7
        kids = range(tree.first[i], tree.last[i])
        if len(kids):
            assert tree.centre[kids[0]] == tree.centre[i]
            assert [tree.begin[c] for c in kids][1:] == [tree.end[c] for c in kids][:-1] and tree.begin[kids[0]] == tree.begin[i] and tree.end[kids[-1]] == tree.end[i]


@pytest.mark.parametrize(("dim", "cosine"), [(2, 0.95), (3, 0.99), (8, 0.95), (16, 0.8), (16, 0.95)])
def test_dual_traversal_gives_the_exact_links(dim, cosine, monkeypatch):
    monkeypatch.setattr(cover_tree, "TOGETHER", 50)
    rng = np.random.default_rng(dim)
    x, y = clustered(rng, 60, dim, 6), clustered(rng, 30, dim, 5)
    y[:40] = x[100:140]
    wx, wy = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
    for wide in (1, 1 << 20):
        monkeypatch.setattr(cover_tree, "WIDE", wide)
        a, b = cover_tree.CoverTree(x), cover_tree.CoverTree(y)
        wa, wb = wx[a.order], wy[b.order]
        one = cover_tree.DualTraversal(a, a, wa, wa, cosine)
        linked = a.x @ a.x.T >= cosine
        np.fill_diagonal(linked, False)
        assert np.array_equal(np.rint(one.links_a), linked @ wa)
        two = cover_tree.DualTraversal(a, b, wa, wb, cosine)
        across = a.x @ b.x.T >= cosine
        assert np.array_equal(np.rint(two.links_a), across @ wb) and np.array_equal(np.rint(two.links_b), across.T @ wa)
        assert one.pruned and two.pruned and one.taken

        def classes(edges, n):
            label = np.arange(n)
            while True:
                new = np.minimum(label, np.where(edges, label, n).min(1))
                if np.array_equal(new, label):
                    return label
                label = new

        assert np.array_equal(one.label, classes(linked, len(x)))
        both = np.zeros((len(x) + len(y),) * 2, bool)
        both[: len(x), len(x) :] = across
        assert np.array_equal(two.label, classes(both | both.T, len(both)))


class Counting(cover_tree.DualTraversal):
    """Counts the pairs of vectors whose own cosine is computed, apart from the pairs of nodes with an extent."""

    def __init__(self, *args):
        self.tested, self.inside = 0, False
        super().__init__(*args)

    def product(self, i, j, own):
        a, b = self.a, self.b
        u, v = a.opened(i, self.reach), b.opened(j, self.reach)
        n, m = int((a.first[u] == a.last[u]).sum()), int((b.first[v] == b.last[v]).sum())
        self.tested += n * (n - 1) // 2 if own else n * m
        self.inside = True
        super().product(i, j, own)
        self.inside = False

    def judge(self, i, j):
        if not self.inside:
            leaves = (self.a.first[i] == self.a.last[i]) & (self.b.first[j] == self.b.last[j])
            self.tested += int((leaves & (i != j)).sum()) if self.same else int(leaves.sum())
        super().judge(i, j)


def test_vectors_apart_in_all_directions_are_all_compared():
    """The given table: no pair of vectors can be left out by its node's radius, so this is a comparison of all; what it links is right."""
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist()
    x = np.unique(np.array(rows, float), axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x)
    found = Counting(tree, tree, np.ones(len(x)), np.ones(len(x)), 0.95)
    every = len(x) * (len(x) - 1) // 2
    assert 0.9 * every < found.tested <= every and np.rint(found.links_a).sum() == 2 * (np.triu(x @ x.T, 1) >= 0.95).sum()


def test_pairs_in_far_or_close_nodes_are_never_compared():
    """Clustered vectors: covering radii leave out pairs of far nodes, and link those of close ones, without any cosine of their vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    x = np.repeat(centres, 200, 0) + rng.normal(size=(2400, 32)) * np.repeat(np.geomspace(0.002, 0.3, 12), 200)[:, None]
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    tree, every = cover_tree.CoverTree(x), len(x) * (len(x) - 1) // 2
    found = Counting(tree, tree, np.ones(len(x)), np.ones(len(x)), 0.95)
    links = (np.triu(x @ x.T, 1) >= 0.95).sum()
    assert np.rint(found.links_a).sum() == 2 * links and links > 50_000
    assert found.tested < 0.6 * every and found.taken


def test_wide_cells_are_cut_by_their_own_nets(spark, monkeypatch):
    """One cell that holds several crowds and near copies across the cuts: few of its blocks meet, and no link is lost."""
    monkeypatch.setattr(cover_tree, "BLOCK", 30)
    monkeypatch.setattr(cover_tree, "CENTRES", 1)
    met = []
    monkeypatch.setattr(cover_tree, "block_pairs", lambda *a, of=cover_tree.block_pairs: met.append(of(*a)) or met[0])
    rng = np.random.default_rng(12)
    crowds = np.eye(16)[:10] + 0.1 * rng.normal(size=(10, 16))
    v = [(crowds[k % 10] + rng.normal(size=16) * 0.08).tolist() for k in range(400)] + [[1.0, float(k)] for k in range(40)]
    got = cover_tree.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == brute(v)
    blocks = {(r[c], r[s], r[p]) for r in met[0].collect() for c, s, p in (("ca", "sa", "pa"), ("cb", "sb", "pb"))}
    pairs = {(r.ca, r.sa, r.pa, r.cb, r.sb, r.pb) for r in met[0].collect()}
    assert len(blocks) > 14 and len(pairs) == met[0].count()
    assert len(pairs) < 0.6 * len(blocks) * (len(blocks) + 1) / 2


def test_null_and_repeated_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v), (4, v), (4, v), (7, [1.0, 2.0, 3.1]), (None, None), (None, [9.0, -1.0, 0.0]), (8, [0.0, 0.0])]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted([(-1, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (7, 3, 4, False), (-1, 0, -1, False), (-1, 0, -1, False), (8, 0, 8, True)])


def test_empty_table(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
