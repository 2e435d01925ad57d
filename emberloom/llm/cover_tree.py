"""Embedding near-duplicates: cover trees of blocks, joined by dual traversal, give the exact pairs over a cosine threshold."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

COSINE = 0.95
#: Vectors of a block, which has one tree.
BLOCK = 16_384
#: The vectors are dealt into at most so many cells, whose centres are the upper levels of a tree over a sample of at most so many vectors, those with the smallest hashes.
CENTRES, SAMPLE = 1024, 4096
#: Parts that a cell of more than a block is cut into by its own nets, for each block that it would fill.
SPREAD = 2
#: Levels of a tree at most: radii from 2, halved from level to level. What lies closer together than the last is a leaf's sibling without being told apart.
LEVELS = 24
#: Room for rounding in bounds: no link is pruned by it, and none is taken for sure within it.
SLACK = 1e-7
#: The same for products in single precision.
ROUGH = 1e-5
#: Node pairs that are looked at together, and children of a pair of nodes from which on their distances are one matrix product.
TOGETHER, WIDE = 1 << 14, 1 << 11
#: Vectors of a node that may be opened early.
FEW = 32


def distance_of(cosine: float) -> float:
    """Distance between unit vectors of this cosine."""
    return float(np.sqrt(max(2 - 2 * cosine, 0.0)))


def distances(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def nets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, parent) of each row of x: the level it enters at, and its parent among the rows that entered before (-1 for the first row, which is level 0).

    The rows of levels up to k are a net of radius r = 2 / 2**k: more than r apart from one another (separation), and every row lies within r of one
    of them (covering). Each net holds the ones before it (nesting). A row that enters at level k lies within 2 r of its parent.
    """
    n = len(x)
    level, parent = np.zeros(n, np.int32), np.full(n, -1, np.int64)
    centres, many = np.empty_like(x), min(n, 1)
    who = np.zeros(n, np.int64)
    centres[:many] = x[:many]
    left = np.arange(1, n)
    parent[left] = 0
    radius = 2.0
    for k in range(1, LEVELS + 1):
        if not len(left):
            break
        if k == LEVELS:
            level[left] = k
            break
        radius /= 2
        least = 1 - radius * radius / 2
        kept = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            dots = x[rows] @ centres[:many].T
            nearest = dots.argmax(1)
            best = dots[np.arange(len(rows)), nearest]
            over, open_ = who[nearest], np.flatnonzero(best < least)
            among = x[rows[open_]] @ x[rows[open_]].T
            free = np.ones(len(open_), bool)
            for i in range(len(open_)):
                if free[i]:
                    level[rows[open_[i]]] = k
                    centres[many], who[many] = x[rows[open_[i]]], rows[open_[i]]
                    many += 1
                    near = np.flatnonzero(free & (among[i] >= least))
                    over[open_[near]] = rows[open_[i]]
                    free[near] = free[i] = False
            new = level[rows] == k
            # who entered keeps the parent it had, the others go on below who covers them
            parent[rows[~new]] = over[~new]
            kept.append(rows[~new])
        left = np.concatenate(kept)
    return level, parent


class CoverTree:
    """An explicit cover tree over unit vectors.

    x has the vectors in the order of the tree, so that each node's are one run, begin to end. A node's centre is one of its vectors, its first child has the same centre
    (nesting), radius is the largest distance from the centre to any of its vectors (covering radius). Children are a run of nodes, first to last; a leaf is one
    vector and has none. Levels that would have a single child are left out.
    """

    __slots__ = ("x", "order", "centre", "radius", "first", "last", "begin", "end", "level")
    ARRAYS = ("x", "order", "centre", "radius", "first", "last", "begin", "end", "level")

    def __init__(self, x: np.ndarray):
        n = len(x)
        level, parent = nets(x)
        by = np.lexsort((level, parent))
        by = by[parent[by] >= 0]
        new = np.flatnonzero(np.r_[True, (np.diff(parent[by]) != 0) | (np.diff(level[by]) != 0)]) if len(by) else np.zeros(0, int)
        below: dict[int, list[np.ndarray]] = {}
        for group in np.split(by, new[1:]) if len(by) else []:
            below.setdefault(int(parent[group[0]]), []).append(group)
        point, enters = [0] * min(n, 1), [0] * min(n, 1)
        rest = [below.get(0, [])] * min(n, 1)
        first, last = [], []
        at = 0
        while at < len(point):
            first.append(len(point))
            if rest[at]:
                group = rest[at][0].tolist()
                k = int(level[group[0]])
                point += [point[at], *group]
                rest += [rest[at][1:], *(below.get(q, []) for q in group)]
                enters += [k] * (len(group) + 1)
            last.append(len(point))
            rest[at] = []
            at += 1
        m = len(point)
        self.first, self.last, self.level = np.array(first, np.int64), np.array(last, np.int64), np.array(enters, np.int32)
        size = [1] * m
        for i in range(m - 1, -1, -1):
            if last[i] > first[i]:
                size[i] = sum(size[first[i] : last[i]])
        begin = [0] * m
        for i in range(m):
            o = begin[i]
            for c in range(first[i], last[i]):
                begin[c] = o
                o += size[c]
        self.begin, self.end = np.array(begin, np.int64), np.array(begin, np.int64) + np.array(size, np.int64)
        leaf = self.first == self.last
        self.order = np.zeros(n, np.int64)
        self.order[self.begin[leaf]] = np.array(point, np.int64)[leaf]
        place = np.zeros(n, np.int64)
        place[self.order] = np.arange(n)
        self.x, self.centre = x[self.order], place[np.array(point, np.int64)]
        self.radius = np.zeros(m)
        for i in np.flatnonzero(~leaf).tolist():
            self.radius[i] = distances(self.x[self.begin[i] : self.end[i]] @ self.x[self.centre[i]]).max()

    def fan(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) of what the nodes are replaced by: their children, a leaf by itself."""
        n = self.last[nodes] - self.first[nodes]
        return np.where(n, self.first[nodes], nodes), np.maximum(n, 1)

    def opened(self, nodes: np.ndarray, least: float) -> np.ndarray:
        """Nodes, those of few vectors but a covering radius over `least` replaced by their children, again and again: they would hardly be pruned as a whole."""
        kept = []
        while len(nodes):
            open_ = (self.radius[nodes] > least) & (self.end[nodes] - self.begin[nodes] <= FEW)
            kept.append(nodes[~open_])
            first, n = self.fan(nodes[open_])
            nodes = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.concatenate(kept) if kept else nodes

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as found:
            for k in cls.ARRAYS:
                setattr(tree, k, found[k])
        return tree


class Classes:
    """Connected classes of n things, as labels: the smallest of each class."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > 1 << 20:
            self.fold()

    def fold(self) -> np.ndarray:
        label = self.label
        a = np.concatenate([h[0] for h in self.held]) if self.held else np.zeros(0, np.int64)
        b = np.concatenate([h[1] for h in self.held]) if self.held else a
        self.held, self.size = [], 0
        while True:
            p, q = label[a], label[b]
            open_ = p != q
            if not open_.any():
                return label
            a, b, p, q = a[open_], b[open_], p[open_], q[open_]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(up := label[label], label):
                label[:] = up


class DualTraversal:
    """Links at the cosine or over it between the vectors of two trees, or inside one (a is b).

    A pair of nodes is replaced by the pairs of their children. One whose centres are further apart than the covering radii and the threshold's distance is pruned; one whose
    farthest members must be near enough links all of its vectors at once, without listing them; of two leaves the cosine decides.

    links_a and links_b: for each vector, in the order of its tree, the weights of the vectors it is linked to. label: connected classes
    of a's vectors and, numbered on from them, b's. pruned, taken and compared count node pairs.
    """

    def __init__(self, a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float):
        self.a, self.b, self.wa, self.wb, self.cosine, self.same = a, b, weight_a, weight_b, cosine, a is b
        self.reach = distance_of(cosine)
        n, m = len(a.x), len(b.x)
        self.shift = 0 if self.same else n
        self.xa = a.x.astype(np.float32)
        self.xb = self.xa if self.same else b.x.astype(np.float32)
        self.add_a, self.add_b = np.zeros(n + 1), np.zeros(m + 1)
        self.sums_a, self.sums_b = np.r_[0.0, np.cumsum(weight_a)], np.r_[0.0, np.cumsum(weight_b)]
        self.classes = Classes(n if self.same else n + m)
        self.pruned = self.taken = self.compared = 0
        self.todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))] if n and m else []
        while self.todo:
            self.expand(*self.todo.pop())
        self.links_a, self.links_b = np.cumsum(self.add_a[:-1]), np.cumsum(self.add_b[:-1])
        if self.same:
            self.links_a = self.links_b = self.links_a + self.links_b
        self.label = self.classes.fold()

    def expand(self, p: np.ndarray, q: np.ndarray) -> None:
        if len(p) > TOGETHER:
            for at in range(0, len(p), TOGETHER):
                self.todo.append((p[at : at + TOGETHER], q[at : at + TOGETHER]))
            return
        (fp, np_), (fq, nq) = self.a.fan(p), self.b.fan(q)
        wide = np_ * nq >= WIDE
        for k in np.flatnonzero(wide).tolist():
            self.product(np.arange(fp[k], fp[k] + np_[k]), np.arange(fq[k], fq[k] + nq[k]), self.same and p[k] == q[k])
        p, q, fp, np_, fq, nq = (v[~wide] for v in (p, q, fp, np_, fq, nq))
        if not len(p):
            return
        fans = np_ * nq
        of = np.repeat(np.arange(len(p)), fans)
        k = np.arange(len(of)) - np.repeat(np.cumsum(fans) - fans, fans)
        i, j = fp[of] + k // nq[of], fq[of] + k % nq[of]
        if self.same:  # a node with itself: each pair of its children once
            keep = (p[of] != q[of]) | (i <= j)
            i, j = i[keep], j[keep]
        for at in range(0, len(i), TOGETHER):
            self.judge(i[at : at + TOGETHER], j[at : at + TOGETHER])

    def product(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """The children of one pair of nodes, tile by tile, in single precision with room for its rounding; who isn't pruned is judged in double precision.

        Children are taken by falling radius, so that those without an extent, whose bound is the sharpest, stand together and have one bound for a tile.
        """
        a, b = self.a, self.b
        i, j = a.opened(i, self.reach), b.opened(j, self.reach)
        i = i[np.argsort(-a.radius[i], kind="stable")]
        j = i if own else j[np.argsort(-b.radius[j], kind="stable")]
        x, y = self.xa[a.centre[i]], self.xb[b.centre[j]].T
        ra, rb = a.radius[i].astype(np.float32), b.radius[j].astype(np.float32)
        reach, flat = np.float32(self.reach + ROUGH), int((rb > 0).sum())
        for at in range(0, len(i), 256):
            rows = slice(at, min(at + 256, len(i)))
            extent = ra[rows]
            low = at if own else 0
            # columns with an extent one by one, those without by one bound
            middle = max(low, flat) if extent[0] == 0 else len(j)
            for columns, bound in ((slice(low, middle), None), (slice(middle, len(j)), 1 - reach * reach / 2 - ROUGH)):
                if columns.start >= columns.stop:
                    continue
                if bound is None:
                    far = np.minimum(extent[:, None] + rb[columns] + reach, 2)
                    bound = 1 - far * far / 2 - np.float32(ROUGH)
                u, v = np.nonzero(x[rows] @ y[:, columns] >= bound)
                u, v = u + at, v + columns.start
                met = len(extent) * (columns.stop - columns.start)
                if own:
                    keep = u <= v
                    u, v = u[keep], v[keep]
                    met = sum(max(columns.stop - max(columns.start, k), 0) for k in range(rows.start, rows.stop))
                self.pruned += met - len(u)
                self.compared += met - len(u)
                for o in range(0, len(u), TOGETHER):
                    self.judge(i[u[o : o + TOGETHER]], j[v[o : o + TOGETHER]])

    def judge(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.a, self.b
        self.compared += len(i)
        rough = np.einsum("ij,ij->i", self.xa[a.centre[i]], self.xb[b.centre[j]])
        far = np.minimum(a.radius[i] + b.radius[j] + self.reach + ROUGH, 2)
        keep = rough >= 1 - far * far / 2 - ROUGH
        self.pruned += len(i) - int(keep.sum())
        i, j = i[keep], j[keep]
        dots = np.einsum("ij,ij->i", a.x[a.centre[i]], b.x[b.centre[j]])
        single = (a.first[i] == a.last[i]) & (b.first[j] == b.last[j])
        selves = (i == j) if self.same else np.zeros(len(i), bool)
        linked = single & ~selves & (dots >= self.cosine)
        self.link(a.begin[i[linked]], b.begin[j[linked]])
        d, extent = distances(dots), a.radius[i] + b.radius[j]
        far = ~single & ~selves & (d - extent > self.reach + SLACK)
        sure = ~single & ~far & (np.where(selves, 0, d) + extent <= self.reach - SLACK)
        self.pruned += int((far | (single & ~linked & ~selves)).sum())
        self.taken += int(sure.sum())
        for p, q in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
            self.link_all(p, q)
        more = ~single & ~far & ~sure
        if more.any():
            self.todo.append((i[more], j[more]))

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        """Single vectors u of a and v of b."""
        if not len(u):
            return
        for add, at, weight in ((self.add_a, u, self.wb[v]), (self.add_b, v, self.wa[u])):
            np.add.at(add, at, weight)
            np.add.at(add, at + 1, -weight)
        self.classes.join(u, v + self.shift)

    def link_all(self, p: int, q: int) -> None:
        """All vectors of two nodes with one another; of a node with itself each with the others."""
        (i, j), (u, v) = (self.a.begin[p], self.a.end[p]), (self.b.begin[q], self.b.end[q])
        self.classes.join(np.arange(i, j), np.full(j - i, i))
        if self.same and p == q:
            self.add_a[i] += self.sums_a[j] - self.sums_a[i]
            self.add_a[j] -= self.sums_a[j] - self.sums_a[i]
            np.add.at(self.add_a, np.arange(i, j), -self.wa[i:j])
            np.add.at(self.add_a, np.arange(i, j) + 1, self.wa[i:j])
            return
        self.add_a[i] += self.sums_b[v] - self.sums_b[u]
        self.add_a[j] -= self.sums_b[v] - self.sums_b[u]
        self.add_b[u] += self.sums_a[j] - self.sums_a[i]
        self.add_b[v] -= self.sums_a[j] - self.sums_a[i]
        self.classes.join(np.arange(u, v) + self.shift, np.full(v - u, u + self.shift))
        self.classes.join(np.array([i]), np.array([u + self.shift]))


def matrix(units: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in units])


def block_tree(block: pd.DataFrame) -> pd.DataFrame:
    """One row: a block's tree, with the names and the copies of its vectors in the tree's order."""
    tree = CoverTree(matrix(block["unit"]))
    rep, copies = block["rep"].to_numpy(np.int64)[tree.order], block["copies"].to_numpy(np.int64)[tree.order]
    return pd.DataFrame({"cell": block["cell"].iloc[:1], "sub": block["sub"].iloc[:1], "part": block["part"].iloc[:1], "tree": [tree.dumps()], "rep": [rep.tobytes()], "copies": [copies.tobytes()]})


def block_links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links inside a block (right is empty), or between two: for each vector the number of vectors it is linked to, copies counted, and edges to one of each class that is linked."""
    a = CoverTree.loads(left["tree"].iloc[0])
    rep, weight = np.frombuffer(left["rep"].iloc[0], np.int64), np.frombuffer(left["copies"].iloc[0], np.int64)
    if len(right):
        b = CoverTree.loads(right["tree2"].iloc[0])
        rep_b, weight_b = np.frombuffer(right["rep2"].iloc[0], np.int64), np.frombuffer(right["copies2"].iloc[0], np.int64)
        found = DualTraversal(a, b, weight, weight_b, float(left["cosine"].iloc[0]))
        every, links = np.r_[rep, rep_b], np.r_[found.links_a, found.links_b]
    else:
        found = DualTraversal(a, a, weight, weight, float(left["cosine"].iloc[0]))
        every, links = rep, found.links_a
    links = np.rint(links).astype(np.int64)
    some, edge = np.flatnonzero(links), np.flatnonzero(found.label != np.arange(len(every)))
    none = lambda n: pd.array([None] * n, "Int64")
    counts = pd.DataFrame({"a": pd.array(every[some], "Int64"), "b": none(len(some)), "n": pd.array(links[some], "Int64")})
    edges = pd.DataFrame({"a": pd.array(every[edge], "Int64"), "b": pd.array(every[found.label[edge]], "Int64"), "n": none(len(edge))})
    return pd.concat([counts, edges])


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and unit: the vector in double precision over its length, as bytes; null where the vector can't link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(v):  # noqa: ANN001, ANN202
            if v is None or not len(v):
                return None
            x = np.array([np.nan if c is None else c for c in v], float)
            if not np.isfinite(x).all() or not x.any():
                return None
            x = x / np.abs(x).max()
            return (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()

        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "unit": [one(v) for v in b[column]]})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias(column)).mapInPandas(run, "vec_id long, unit binary")


def centres_of(sample: list[bytes], n: int) -> list[bytes]:
    """About n of the sample as centres of cells: those that enter a cover tree over it first, level by level, so they lie far apart. Each length of vector has one at least."""
    found = []
    for size in sorted({len(v) for v in sample}):
        own = [v for v in sample if len(v) == size]
        tree = CoverTree(np.stack([np.frombuffer(v, "<f8") for v in own]))
        points = list(dict.fromkeys(tree.centre.tolist()))[: max(1, n * len(own) // len(sample))]
        found += [own[tree.order[k]] for k in points]
    return found


def cell_pairs(cells: list[tuple[int, float]], centres: list[bytes], cosine: float) -> pd.DataFrame:
    """(ca, cb) of the cells (cell, radius) that can hold a link, each pair once."""
    at = {k: np.frombuffer(v, "<f8") for k, v in enumerate(centres)}
    rows = []
    for i, (ca, ra) in enumerate(cells):
        near = [(cb, rb) for cb, rb in cells[i:] if len(at[ca]) == len(at[cb])]
        gaps = distances(np.stack([at[cb] for cb, _ in near]) @ at[ca])
        rows += [(ca, cb) for (cb, rb), g in zip(near, gaps.tolist(), strict=True) if cb == ca or g - ra - rb <= distance_of(cosine) + SLACK]
    return pd.DataFrame(rows, columns=["ca", "cb"]).astype({"ca": "int32", "cb": "int32"})


def cell_nets(placed: DataFrame) -> DataFrame:
    """cell, sub, centre: for cells of more than a block (n vectors) the points of the upper nets of the cell's own tree, over about SAMPLE of its vectors, those with small hashes."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("rep").head(2 * SAMPLE)
        tree = CoverTree(matrix(sample["unit"]))
        points = list(dict.fromkeys(tree.centre.tolist()))[: SPREAD * -(-int(sample["n"].iloc[0]) // BLOCK)]
        return pd.DataFrame({"cell": sample["cell"].iloc[0], "sub": np.arange(len(points), dtype=np.int32), "centre": [tree.x[p].tobytes() for p in points]})

    drawn = F.pmod(F.xxhash64(F.lit("net"), "unit"), F.lit(1 << 20)) < F.lit(float(SAMPLE << 20)) / F.col("n")
    return placed.filter(drawn).select("cell", "n", "rep", "unit").groupBy("cell").applyInPandas(run, "cell int, sub int, centre binary")


def subdivided(placed: DataFrame, wide: DataFrame, nets: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed with sub, subs): vectors of wide cells go to the nearest point of their cell's nets, those of other cells keep its centre; subs has cell, sub, centre, radius and blocks.

    A wide cell is dealt over as many tasks as it has blocks, each with the cell's nets. A part that is still over a block is cut by hash, and all of its blocks meet.
    """

    def nearest(rows: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows[["cell", "unit", "rep", "copies"]].assign(sub=0, far=0.0)
        if not len(net):  # nothing drawn: one part, as wide as can be
            return rows[["cell", "unit", "rep", "copies"]].assign(sub=0, far=2.0)
        centre, at, far = matrix(net["centre"]).T, np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for k in range(0, len(rows), 1024):
            dots = matrix(rows["unit"].iloc[k : k + 1024]) @ centre
            at[k : k + 1024], far[k : k + 1024] = dots.argmax(1), distances(dots.max(1))
        return rows[["cell", "unit", "rep", "copies"]].assign(sub=net["sub2"].to_numpy()[at], far=far)

    salted = placed.join(wide.select("cell", "blocks"), "cell").select("cell", "unit", "rep", "copies", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt2")
    copied = nets.join(wide.select("cell", "blocks"), "cell").select(F.col("cell").alias("cell2"), F.col("sub").alias("sub2"), "centre", salts)
    schema = "cell int, unit binary, rep long, copies long, sub int, far double"
    cut_up = salted.groupBy("cell", "salt").cogroup(copied.groupBy("cell2", "salt2")).applyInPandas(nearest, schema)
    rest = placed.join(wide.select("cell"), "cell", "left_anti").select("cell", "unit", "rep", "copies", F.lit(0).alias("sub"), "far")
    both = stored(cut_up.unionByName(rest), "parts")
    extent = both.groupBy("cell", "sub").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    named = nets.unionByName(centres.join(wide, "cell", "left_anti").select("cell", F.lit(0).alias("sub"), "centre"))
    # a cell of a length that the sample doesn't have is without a centre, if it is no more than a block
    return both, stored(extent.join(named, ["cell", "sub"], "left").select("cell", "sub", "centre", "radius", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "subs")


def block_pairs(met: DataFrame, subs: DataFrame, cosine: float) -> DataFrame:
    """ca, sa, pa, cb, sb, pb, same, pair: the blocks (cell, part of the cell, block) that can hold a link by the radii of their parts, each pair once."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y, rx, ry, one in zip(b["xa"], b["xb"], b["ra"], b["rb"], b["one"], strict=True):
                # without centres there is no bound
                gap = 0.0 if one or x is None or y is None else float(distances(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")))
                keep.append(gap - rx - ry <= distance_of(cosine) + SLACK)
            yield b.loc[np.array(keep, bool), ["ca", "sa", "na", "cb", "sb", "nb"]]

    side = lambda c: subs.select(F.col("cell").alias(f"c{c}"), F.col("sub").alias(f"s{c}"), F.col("centre").alias(f"x{c}"), F.col("radius").alias(f"r{c}"), F.col("blocks").alias(f"n{c}"))
    parts = met.join(side("a"), "ca").join(side("b"), "cb").filter("ca <> cb or sa <= sb").withColumn("one", F.expr("ca = cb and sa = sb"))
    parts = parts.mapInPandas(near, "ca int, sa int, na int, cb int, sb int, nb int")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = parts.select("*", numbers("na").alias("pa")).select("*", numbers("nb").alias("pb")).filter("ca <> cb or sa <> sb or pa <= pb")
    return pairs.select("ca", "sa", "pa", "cb", "sb", "pb", F.expr("ca = cb and sa = sb and pa = pb").alias("same"), F.monotonically_increasing_id().alias("pair"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors of one direction (the same unit vector to the last bit) are made one first, their number is kept, so that a vector that many rows share is a single one from
    there on. The rest is dealt to the nearest of a bounded number of centres, the upper levels of a cover tree over a bounded sample; a cell of more than a block is cut again, by the upper nets of
    a tree of its own; parts are cut into blocks of bounded size, each block's cover tree is built once, and each pair of blocks whose parts' covering radii let them hold a link is
    joined in a task by dual traversal of their trees. A task gives counts and a spanning forest of what it linked, not all pairs. Vectors of different lengths of array never
    link. Exact joins of vectors that lie apart in all directions can exclude few pairs of blocks; then the work is that of all of them, and pruning happens inside the trees.

    Null, zero or non-finite vectors get no links and are components of their own; null vec_ids are carried with a null component unless a
    copy has an id; rows that repeat a vec_id count as vectors of their own; an empty table gives no rows.
    """
    units = stored(unit_vectors(vectors, column), "units")
    distinct = units.filter("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # numbers are told apart by the partition that writes them, and are fixed once written
    distinct = stored(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct-units")
    spark = vectors.sparkSession
    n = distinct.count()
    sample = [bytes(r["unit"]) for r in distinct.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE if n > BLOCK else 1).collect()]
    centres = centres_of(sample, min(CENTRES, -(-n // BLOCK))) if sample else []

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far = np.zeros(len(b), np.int32), np.zeros(len(b))
            sizes = b["unit"].map(len).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                c = [k for k, v in enumerate(centres) if len(v) == size]
                if not c:  # a length that the sample doesn't have is a cell of its own
                    cell[rows] = -int(size)
                    continue
                dots = matrix(b["unit"].iloc[rows]) @ np.stack([np.frombuffer(centres[k], "<f8") for k in c]).T
                cell[rows] = np.asarray(c)[dots.argmax(1)]
                far[rows] = distances(dots.max(1))
            yield b.assign(cell=cell, far=far)

    placed = stored(distinct.select("unit", "rep", "copies").mapInPandas(place, "unit binary, rep long, copies long, cell int, far double"), "placed-units")
    total = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = stored(total.select("cell", "n", "radius", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cells")
    wide = cells.filter(F.col("n") > BLOCK)
    nets = stored(cell_nets(placed.join(wide.select("cell", "n"), "cell")), "nets")
    placed, subs = subdivided(placed, wide, nets, stored(spark.createDataFrame([(k, bytearray(v)) for k, v in enumerate(centres)], "cell int, centre binary"), "centres"))
    dealt = placed.join(subs.select("cell", "sub", "blocks"), ["cell", "sub"])
    dealt = dealt.select("cell", "sub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("part"), "unit", "rep", "copies")
    trees = stored(dealt.groupBy("cell", "sub", "part").applyInPandas(block_tree, "cell int, sub int, part int, tree binary, rep binary, copies binary"), "trees")
    known = [(r["cell"], r["radius"]) for r in cells.filter("cell >= 0").orderBy("cell").collect()]  # no more than centres
    met = spark.createDataFrame(cell_pairs(known, centres, cosine), "ca int, cb int")
    met = met.unionAll(cells.filter("cell < 0").select("cell", "cell"))
    pairs = stored(block_pairs(met, subs, cosine), "block-pairs")
    block = ["cell", "sub", "part"]
    left = pairs.select(F.col("ca").alias("cell"), F.col("sa").alias("sub"), F.col("pa").alias("part"), "pair").join(trees, block).select("pair", F.lit(cosine).alias("cosine"), "tree", "rep", "copies")
    right = pairs.filter("not same").select(F.col("cb").alias("cell"), F.col("sb").alias("sub"), F.col("pb").alias("part"), "pair").join(trees, block)
    right = right.select(F.col("pair").alias("pair2"), F.col("tree").alias("tree2"), F.col("rep").alias("rep2"), F.col("copies").alias("copies2"))
    linked = left.groupBy("pair").cogroup(right.groupBy("pair2")).applyInPandas(block_links, "a long, b long, n long")
    found = stored(linked, "links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = distinct.select("unit", "rep", "least", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = units.join(named, "unit", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
