"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically on shallow trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, whole_row, whole_text, words_of

FEATURES = ("log_words", "mean_word", "symbols", "upper", "pipes", "distinct_words", "same_next", "dup_lines", "bangs", "digits", "words_a_line", "stops")
#: The model is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3


def features() -> Column:
    """The features of the whole text, in the order of FEATURES; what is counted in nothing is 0. Only the text is looked at."""
    t = whole_text()
    # bound once by one-element arrays, so that words and lines aren't split again for every feature
    parts = F.struct(words_of(t).alias("w"), F.length(F.translate(t, SPACE_CHARS, "")).alias("c"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("l"))
    share = lambda x, of: F.when(of > 0, x.cast("double") / of).otherwise(F.lit(0.0))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))

    def all_of(p: Column) -> Column:
        w, c, lines = p["w"], p["c"], p["l"]
        n = F.size(w)
        same = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i + 1) == x, F.lit(False))))
        found = (
            F.log1p(n.cast("double")),
            share(c, n),
            share(without("#*$%&<>"), c),
            share(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), c),
            share(without("|"), n),
            share(F.size(F.array_distinct(w)), n),
            share(same, n),
            share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
            share(without("!"), n),
            share(without("0123456789"), c),
            F.log1p(share(n, F.size(lines))),
            share(without(".?"), n),
        )
        return F.array(*found)

    return F.element_at(F.transform(F.array(parts), all_of), 1)


@dataclass
class Additive:
    """Tables of scores by bin: one for each feature, and one for each chosen pair on coarser bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    main: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; a bin lookup and an addition for each table."""
        x = np.nan_to_num(x)
        z = np.full(len(x), self.intercept)
        for t, b in zip(self.main, self.bins(x, self.edges), strict=True):
            z += t[b]
        b = self.bins(x, self.coarse)
        for (i, j), t in zip(self.pairs, self.tables, strict=True):
            z += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def step_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Newton values of a tree with few leaves on ordered bins, from sums of gradients and curvatures by bin."""
    gain = lambda a, b: a * a / (b + l2)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            win = np.where((hl >= least * 0.1) & (ht - hl >= least * 0.1), gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht), -1)
            k = int(win.argmax())
            if win[k] > best[0]:
                best = (win[k], lo + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + l2)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton values of the best tree that cuts the first feature once and then the second once on each side, and its gain."""
    gain = lambda a, b: a * a / (b + l2)
    best, out = 0.0, np.zeros_like(g)
    whole = gain(g.sum(), h.sum())
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            table, won = np.zeros_like(a), -whole
            for rows in (slice(0, cut), slice(cut, None)):
                ga, ha = a[rows].sum(0), b[rows].sum(0)
                v = step_tree(ga, ha, leaves=2, l2=l2)
                table[rows] = v
                won += (v * v * (ha + l2 / len(v))).sum()
            if won > best:
                best, out = won, table.T if flip else table
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pairs: int = 6, pair_rounds: int = 30) -> Additive:
    """Cyclic boosting: each round gives every feature one small tree on what the rest leaves over; then the pairs with the most left over."""
    x = np.nan_to_num(np.asarray(x, float))
    y = np.asarray(y, float)
    width = x.shape[1]
    cuts = lambda n: [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(width)]
    edges, coarse = cuts(bins), cuts(8)
    p = (y.sum() + 0.5) / (len(y) + 1)
    m = Additive(edges, coarse, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    if len(set(y.tolist())) < 2:
        return m
    z = np.full(len(y), m.intercept)
    at = m.bins(x, edges)
    slope = lambda z: (y - (q := 1 / (1 + np.exp(-z))), q * (1 - q))
    for _ in range(rounds):
        for i in range(width):
            g, h = slope(z)
            k = len(m.main[i])
            v = rate * step_tree(np.bincount(at[i], g, k), np.bincount(at[i], h, k))
            m.main[i] += v
            z += v[at[i]]
    at = m.bins(x, coarse)
    size = [len(e) + 1 for e in coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slope(z)
        flat, n = at[i] * size[j] + at[j], size[i] * size[j]
        return np.bincount(flat, g, n).reshape(size[i], size[j]), np.bincount(flat, h, n).reshape(size[i], size[j])

    ranked = sorted(((cross_tree(*sums(i, j))[1], i, j) for i in range(width) for j in range(i + 1, width)), key=lambda r: (-r[0], r[1:]))
    m.pairs = [(i, j) for won, i, j in ranked[:pairs] if won > 0]
    m.tables = [np.zeros((size[i], size[j])) for i, j in m.pairs]
    for _ in range(pair_rounds if m.pairs else 0):
        for k, (i, j) in enumerate(m.pairs):
            v = rate * cross_tree(*sums(i, j))[0]
            m.tables[k] += v
            z += v[at[i], at[j]]
    return m


def held_out() -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Additive:
    """A model of labels.quality from rows that aren't held out. The sample, its ids and then its features, is bounded by max_rows, wherever it goes.

    Labels other than 0 and 1, and those without a doc_id, teach nothing; of labels that contradict one another 1 counts.
    """
    docs = docs.select("doc_id", "text")
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas()
    ids = docs.sparkSession.createDataFrame(drawn.astype({"doc_id": "int64", "quality": "int32"}), "doc_id long, quality int")
    texts = docs.join(F.broadcast(ids.withColumnsRenamed({"doc_id": "_d"})), F.col("doc_id") == F.col("_d"))
    sample = texts.select("quality", features().alias("f")).orderBy(F.xxhash64("f"), "f").limit(max_rows).toPandas()
    return fit(np.stack(sample["f"]) if len(sample) else np.zeros((0, len(FEATURES))), sample["quality"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs with held_out, score and predicted; columns of these names are replaced.

    One pass without a shuffle. Texts may be null or empty: they get the score of features that are all 0. Repeated rows are scored alike, rows without a doc_id like others
    (they are not held out); without labels of both kinds every score is the prior (0.5 when there are none).
    """
    model = train(docs, labels, max_rows)

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in columns])))

    row = whole_row(docs, ("held_out", "score", "predicted"))
    # one row for one: the explode keeps the features a column of their own, which no filter on the score brings into the function's arguments
    out = docs.select(row.alias("row"), held_out().alias("held_out"), F.explode(F.array(features())).alias("f"))
    out = out.select("row", "held_out", scored(*[F.element_at("f", k + 1) for k in range(len(FEATURES))]).alias("score"))
    return out.select("row.*", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
