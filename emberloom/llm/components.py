"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, stored


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node that it reaches.

    Only minima are taken of a node's neighbours, so a hub is pre-aggregated before the shuffle, and the joins back can be split by
    adaptive execution where one node holds many edges. The driver sees a count and a hash each round, never the edges. Self-loops and
    nulls are left out; no edges give no rows.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("a is not null and b is not null and a <> b").distinct()
    e = cut(few(e))
    seen = signature(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stored(few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "star-minima")
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = cut(few(large))
        least = stored(few(large.groupBy("hi").agg(F.min("lo").alias("m"))), "star-minima")
        small = large.join(least, "hi").filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        e = cut(few(small.unionAll(least.select(F.col("m").alias("lo"), "hi")).distinct()))
        now = signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
