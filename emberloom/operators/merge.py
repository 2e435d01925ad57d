"""Merges into stored tables: revisions of events, new hotspots, feed marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EVENT_KEY, HOTSPOT_KEY, REVISED


def last_of_batch(batch: DataFrame, key: tuple[str, ...], position: str) -> DataFrame:
    """Of rows with one key the last in the batch."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(position)))).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, batch: DataFrame, position: str = "batch_pos") -> DataFrame:
    """stored with the batch's revisions and new events.

    A revision sets what the feed reports; id, cluster and everything derived stay. New rows have nulls in columns that the batch lacks. One
    shuffle by key.
    """
    new = last_of_batch(batch, EVENT_KEY, position).drop(position)
    revised = [c for c in REVISED if c in new.columns]
    # a row of the batch rules even where it says null; its keys are never null
    from_batch = F.col("n._is_new").isNotNull()
    joined = stored.alias("s").join(new.withColumn("_is_new", F.lit(True)).alias("n"), list(EVENT_KEY), "full_outer")
    pick = lambda c: F.when(from_batch, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))
    columns = [pick(c).alias(c) if c in revised else F.coalesce(f"s.{c}", f"n.{c}").alias(c) if c in new.columns and c not in EVENT_KEY else F.col(c if c in EVENT_KEY else f"s.{c}") for c in stored.columns]
    return joined.select(*columns)


def inserted(stored: DataFrame, batch: DataFrame, position: str = "batch_pos") -> DataFrame:
    """The batch's events that aren't stored yet: only they go on to enrichment and clustering."""
    return last_of_batch(batch, EVENT_KEY, position).join(stored.select(*EVENT_KEY), list(EVENT_KEY), "left_anti")


def insert_hotspots(stored: DataFrame, batch: DataFrame, position: str = "batch_pos") -> DataFrame:
    """The hotspots that are new, the first of each key in the batch."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*HOTSPOT_KEY).orderBy(position))).filter("_n = 1").drop("_n")
    return first.join(stored.select(*HOTSPOT_KEY), list(HOTSPOT_KEY), "left_anti")


def update_marks(marks: DataFrame, runs: DataFrame) -> DataFrame:
    """Feed marks after one run each: runs has source, ok, at, watermark, new_records, error.

    A success clears the error and its count, adds the records and keeps the old mark if it brings none; a failure keeps the mark, counts itself (or, with a column failures, so many) and the
    first 1000 characters of its message.
    """
    times = F.col("r.failures") if "failures" in runs.columns else F.lit(1)
    m, r = marks.alias("m"), runs.alias("r")
    ran, ok = F.col("r.ok").isNotNull(), F.coalesce(F.col("r.ok"), F.lit(False))
    old = lambda c, d: F.coalesce(F.col(f"m.{c}"), F.lit(d))
    return m.join(r, "source", "full_outer").select(
        "source",
        F.when(ok, F.coalesce("r.watermark", "m.watermark")).otherwise(F.col("m.watermark")).alias("watermark"),
        F.when(ok, F.col("r.at")).otherwise(F.col("m.last_success_at")).alias("last_success_at"),
        F.when(ran, F.col("r.at")).otherwise(F.col("m.last_attempt_at")).alias("last_attempt_at"),
        F.when(ok, F.lit(None)).when(ran, F.substring("r.error", 1, 1000)).otherwise(F.col("m.last_error")).alias("last_error"),
        F.when(ok, 0).when(ran, old("consecutive_failures", 0) + times).otherwise(old("consecutive_failures", 0)).cast("int").alias("consecutive_failures"),
        (old("records_ingested", 0) + F.when(ok, F.col("r.new_records")).otherwise(0)).cast("long").alias("records_ingested"),
    )
