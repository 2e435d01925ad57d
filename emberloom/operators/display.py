"""What a display says of events and feeds, as texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import seconds

ERROR_SHOWN = 80


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def time_ago(t: Column, now: datetime) -> Column:
    """Minutes below an hour, hours below two days, days."""
    minutes = half_up((seconds(F.lit(now).cast("timestamp_ntz")) - seconds(t)) / 60)
    hours = half_up(minutes / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(minutes < 60, text(minutes, "min")).when(hours < 48, text(hours, "h")).otherwise(text(half_up(hours / 24), "d"))


def utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm 'UTC'")


def outlet(url: Column) -> Column:
    """The host of a url without www, in lower case; what has no host stays as it is."""
    host = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(host == "", url).otherwise(F.regexp_replace(F.lower(host), r"^www\.", ""))


def feed_label(health: DataFrame, now: datetime) -> DataFrame:
    """(source, label, bad) of feed_health's rows: what a status bar says of each feed."""
    said = lambda *parts: F.concat(F.col("source"), F.lit(": "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    status, error = F.col("credential_status"), F.col("last_error")
    short = F.when(F.length(error) > ERROR_SHOWN, F.concat(F.left(error, F.lit(ERROR_SHOWN)), F.lit("…"))).otherwise(error)
    dead, degraded, failed = status == "dead", status == "degraded", F.coalesce(error, F.lit("")) != ""
    label = (
        F.when(dead, said("credential dead"))
        .when(degraded, said("auth degraded, retrying"))
        .when(failed, said(F.col("consecutive_failures").cast("string"), " failed — ", short))
        .when(F.col("last_success_at").isNotNull(), said("ok ", time_ago(F.col("last_success_at"), now)))
        .otherwise(said("no data yet"))
    )
    return health.select("source", label.alias("label"), F.coalesce(dead | degraded, F.lit(False)).__or__(failed).alias("bad"))
