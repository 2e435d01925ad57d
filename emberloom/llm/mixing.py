"""Mixing sources to target weights: whole passes first, then a subset of documents whose lengths sum to what is left of the target."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_row, whole_text, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_PASSES, SEED = 1.5, 2.0, 17
#: Documents of one length and source are chosen within hash slices, so that a length which many share is dealt over tasks: one for each SLICE documents in all, and some at least.
SLICE, LEAST_SLICES = 1_000_000, 64
#: Of the bitsets of the search every so many is kept; those between are worked out again.
KEPT_STEPS = 128
#: What mix adds to a document's columns.
ADDED = ("_words", "_source_size", "_target", "_copies")
#: Words of a source that are left to the exact search; what is over is filled longest first.
SEARCH_WORDS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) of each source in sizes (source, source_size); a row for each source, so they fit one task.

    Sources by code point, null last, weigh `weights` in turn. Together they get `share` of all sizes; none gets over `most` times its own size, and
    what is over goes to the others by weight. That is target = min(most * size, level * weight): in the order of size by weight the full sources
    come first, and level is what they leave, by the weight of the rest.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * float(share)
    s = s.withColumns({"total": total, "full": F.sum("cap").over(upto) - F.col("cap"), "left": F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")})
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    # the level is right at the first source that it doesn't fill
    s = s.withColumn("right", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("right") * F.col("w"), F.col("cap"))).alias("target"))


def subset(lengths: list[int], counts: list[int], budget: int, search: int = SEARCH_WORDS) -> list[int]:
    """How many documents of each length to choose so that their words come as near below the budget as can be.

    An even share of each length first, so that the choice looks like its source; then longest first down to the search budget; and the rest by
    bounded-knapsack dynamic programming: a bit for each reachable sum, a binary bundle of documents for each step.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    part = max(budget - search // 2, 0) / total if total else 0.0
    chosen = [int(c * part) for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, chosen, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        if left <= search:
            break
        k = min(counts[i] - chosen[i], (left - search) // lengths[i])
        chosen[i] += k
        left -= k * lengths[i]
    bundles = []
    for i in order:
        spare, size = min(counts[i] - chosen[i], left // lengths[i]), 1
        while spare > 0:
            k = min(size, spare)
            bundles.append((i, k))
            spare -= k
            size *= 2
    mask, reach, kept, done = (1 << (left + 1)) - 1, 1, [], 0
    step = lambda reach, i, k: reach | reach << (k * lengths[i]) & mask
    for i, k in bundles:
        if reach >> left & 1:
            break
        if done % KEPT_STEPS == 0:
            kept.append(reach)
        reach = step(reach, i, k)
        done += 1
    at = reach.bit_length() - 1
    for first in range(len(kept) - 1, -1, -1):
        part = bundles[first * KEPT_STEPS : min((first + 1) * KEPT_STEPS, done)]
        before = [kept[first]]
        for i, k in part[:-1]:
            before.append(step(before[-1], i, k))
        for was, (i, k) in zip(reversed(before), reversed(part), strict=True):
            if not was >> at & 1:
                chosen[i] += k
                at -= k * lengths[i]
    return chosen


def choose_lengths(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source's histogram: passes over all documents, and the number of documents of each length that get one more."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    pdf = pdf.sort_values("size")
    pdf["extra"] = subset(pdf["size"].tolist(), pdf["n"].tolist(), int(target) - passes * size)
    return pdf.assign(passes=passes)[["source", "size", "source_size", "target", "passes", "extra"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """docs with _words, _source_size, _target and _copies, the number of times that the mix takes each document; columns of these names are replaced.

    Words are runs of characters other than ASCII white space; a null text has none. Every document is taken in each whole pass, and some once more:
    of each length the number that the search asks for, those with the smallest seeded hashes of doc_id and text, slice by slice. So reruns agree. Rows alike have
    one hash: the extra pass takes all of them or none, and where that is undecided none. Only lengths and hashes
    are sorted; counts of lengths by source are gathered in a group for each source, and the targets of sources in one task, a row each. A null source is a source of
    its own; an empty table gives no rows.
    """
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), whole_text())
    own = docs.select(whole_row(docs, ADDED).alias("row"), F.col("source").alias("of"), F.size(words_of(whole_text())).cast("long").alias("size"), draw.alias("draw"))
    sized = stored(own.select("of", "size", "draw"), "lengths")
    slices = max(LEAST_SLICES, sized.count() // SLICE)
    sized = sized.withColumn("slice", F.pmod("draw", F.lit(slices)))
    counts = stored(sized.groupBy("of", "size", "slice").agg(F.count("*").alias("n")), "length-counts")
    histogram = counts.groupBy(F.col("of").alias("source"), "size").agg(F.sum("n").alias("n"))
    aims = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    schema = "source string, size long, source_size long, target double, passes int, extra long"
    wanted = histogram.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    chosen = stored(wanted.groupBy("source").applyInPandas(choose_lengths, schema), "chosen-lengths")
    # the slices give their documents in turn until the number is reached; within the slice where that is, a hash is the bound
    turn = Window.partitionBy("of", "size").orderBy("slice")
    upto = counts.withColumn("upto", F.sum("n").over(turn))
    upto = upto.join(chosen.select(F.col("source").alias("_s"), F.col("size").alias("_n"), "extra"), F.col("of").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
    last = upto.filter("upto > extra and upto - n <= extra").select(F.col("of").alias("_s"), F.col("size").alias("_n"), F.col("slice").alias("_l"), (F.col("extra") - F.col("upto") + F.col("n")).alias("some"))
    here = F.col("of").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")) & (F.col("slice") == F.col("_l"))
    place = F.row_number().over(Window.partitionBy("_s", "_n").orderBy("draw"))
    bounds = sized.join(last, here).withColumn("place", place).filter("place > some").groupBy("_s", "_n", "_l").agg(F.min("draw").alias("bound"))
    bounds = bounds.withColumnsRenamed({"_s": "_bs", "_n": "_bn"})
    quota = chosen.join(bounds, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("size") == F.col("_bn")), "left")
    quota = stored(quota.select(F.col("source").alias("_s"), F.col("size").alias("_n"), "source_size", "target", "passes", "_l", "bound"), "quotas")
    drawn = own.join(quota, F.col("of").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
    piece = F.pmod("draw", F.lit(slices))
    # no bound: all documents of the length
    more = F.col("_l").isNull() | (piece < F.col("_l")) | ((piece == F.col("_l")) & (F.col("draw") < F.col("bound")))
    return drawn.select("row.*", F.col("size").alias("_words"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), (F.col("passes") + more.cast("int")).alias("_copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, without what mix added."""
    kept = [F.col(f"`{c}`") for c in mixed.columns if c not in ADDED]
    copies = mixed.filter("_copies > 0").select(F.struct(*kept).alias("row"), F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select("row.*")
