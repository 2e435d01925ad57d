"""SimHash near-duplicates: every fingerprint meets its neighbours halfway, on the variants inside half the radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored, whole_text
from .components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Shingles that are hashed and counted bit by bit at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash of a text's k-word shingles, repeats counted; 0 without words. Signed, as Spark keeps it."""
    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - k + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        shingles = [b" ".join(part)] if len(words) < k else map(b" ".join, zip(*(part[i:] for i in range(k))))
        h = np.array([digest(s, SEED) for s in shingles], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp and the hash x of the text of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), k) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], ["doc_id", "fp", "x"])

    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("x")).mapInArrow(run, "doc_id long, fp long, x long")


def ball(radius: int) -> list[int]:
    """Masks that flip at most radius of 64 bits, signed."""
    masks = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct values in column fp that connect exactly what pairs at `radius` or fewer differing bits connect.

    Both ends of such a pair have a variant in common, each flipping half of the differing bits. Values are made distinct first, so at
    most one for each member of the ball meets on a variant, however many documents share a value. All that meet on a variant are
    within the radius of one another (the triangle inequality), so linking each with the smallest keeps every connection without listing all pairs. The
    distance is verified all the same.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = fps.select("fp").distinct().select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.withColumn("a", F.min("fp").over(Window.partitionBy("variant")))
    found = met.filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def classes(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(marked, rooted): the fingerprints of all rows, and fp, root of the distinct ones."""
    marked = stored(fingerprints(docs), "fingerprints")
    parts = components(links(marked, radius)).withColumnRenamed("node", "fp")
    return marked, stored(few(marked.select("fp").distinct().join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))), "roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row; component_id is the smallest doc_id that links reach.

    Empty and null texts have fingerprint zero and are linked like any other. Null doc_ids are carried, but a component is named by the
    smallest one that isn't null. Repeated rows come out as often as they came in.
    """
    marked, rooted = classes(docs, radius)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(few(rooted.join(names, "root").select("fp", "component_id")), "classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, x): of each component the row that stays, by its doc_id and the xxhash64 of its text: the smallest doc_id, null last, of equals the smallest hash."""
    marked, rooted = classes(docs, radius)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x"))
    each = marked.groupBy("fp").agg(best.alias("best")).join(rooted, "fp")
    return each.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.x")
