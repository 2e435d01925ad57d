"""Line dedup: a long line that many documents hold stays in the last of them only. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, stored, whole_row, whole_text

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Lines that more rows hold than the COMMON-th part of all are looked up by broadcast: there can't be more than COMMON of them.
COMMON, LEAST_COMMON = 100_000, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """A line without ASCII white space at its ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(d, x, pos, h, g): document, checksum of its text, place of a line of enough characters, and 128 bits of hash of its key."""
    rows = docs.select(F.col("doc_id").alias("d"), whole_text().alias("t"))
    lines = rows.select("d", F.xxhash64("t").alias("x"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    keys = lines.select("d", "x", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return keys.select("d", "x", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def dropped_places(keys: DataFrame, least_docs: int = LEAST_DOCS, common: int = COMMON, least_common: int = LEAST_COMMON) -> DataFrame:
    """(d, x, places): the places of the lines that go, in order, for each text that loses any. keys is read three times and should be stored.

    Documents are counted by hash with the distinct pairs of hash and document spread first, so a line that a third of all documents hold is a third of no task.
    Lines that stand in more than the `common`-th part of all rows meet their verdict by broadcast, of which there are `common` at most; no other has more rows for one task.
    """
    held = keys.groupBy("h", "g").agg(
        (F.count_distinct("d") + F.max(F.col("d").isNull().cast("int"))).alias("n_docs"),  # no id is one document, the smallest
        F.max("d").alias("last"),
        F.count("*").alias("n_rows"),
    )
    most = max(least_common, keys.count() // common)
    verdicts = stored(held.filter((F.col("n_docs") >= least_docs) | (F.col("n_rows") > most)), "verdicts").withColumn("goes", F.col("n_docs") >= least_docs)
    often = F.col("n_rows") > most
    met = keys.join(F.broadcast(verdicts.filter(often).select("h", "g", "last", "goes")), ["h", "g"], "left")
    seldom = met.filter("goes is null").select("d", "x", "pos", "h", "g").join(verdicts.filter(~often).select("h", "g", "last", "goes"), ["h", "g"])
    gone = met.filter("goes").unionByName(seldom).filter(~F.col("d").eqNullSafe(F.col("last")))
    return gone.groupBy("d", "x").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def without(lines: Column, places: Column) -> Column:
    """An array without the elements at some places, which are in order, from 0: the runs between them, one after another."""
    runs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1)).alias("a"), F.concat(places, F.array(F.size(lines))).alias("b"))
    return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with text as it is left, n_lines (before) and n_dropped; columns of these names are replaced, all others kept.

    Lines are what \\n parts; a null or empty text is one empty line and stays empty. A line of least_chars characters at least, compared without white space at its ends and without A-Z case, that least_docs
    documents hold goes from all but the largest doc_id that holds it, each time it stands there; null is the smallest. Documents are told apart by doc_id, so rows that share one count once, and rows alike lose alike.
    """
    places = dropped_places(stored(line_keys(docs, least_chars), "line-keys"), least_docs)
    text = [F.col("doc_id").alias("_d"), F.xxhash64(whole_text()).alias("_x"), whole_text().alias("_t")]
    rows = docs.select(*text, whole_row(docs, ("text", "n_lines", "n_dropped")).alias("_row"))
    met = rows.join(places, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_x") == F.col("x")), "left").select("_row", "_t", "places", F.split("_t", "\n").alias("_lines"))
    kept = F.when(F.col("places").isNull(), F.col("_t")).otherwise(F.array_join(without(F.col("_lines"), F.col("places")), "\n"))
    found = F.struct(kept.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
    return met.select("_row", found.alias("_found")).select("_row.*", "_found.*")
