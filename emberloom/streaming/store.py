"""Stored state of the streams: Parquet tables by day, of which a batch reads and writes only the days that it touches."""

from __future__ import annotations

import threading
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVENT_KEY

#: Buckets of the table of keys; a bucket should be no more than a task reads in a moment.
BUCKETS = 64
#: A part of a table is written anew when it has more folders than this.
MOST_FOLDERS = 32
#: What each table is cut by; the others by nothing, as they have a row or a few names for each batch.
BY = {"events": "day", "weapons": "day", "clusters": "day", "hotspots": "day", "keys": "bucket"}
KEY = {"events": EVENT_KEY, "weapons": ("event_id", "weapon_key"), "clusters": ("cluster_id",), "hotspots": None, "keys": EVENT_KEY}
COMPACTED = "compacted"


def day_of(t: Column) -> Column:
    """The day of a time, and of none the first."""
    return F.coalesce(t.cast("date"), F.lit("1970-01-01").cast("date"))


def days_of(times: DataFrame, before_s: float = 0, after_s: float = 0) -> list[str]:
    """The days that [t - before_s, t + after_s] of any t touches. As many as the calendar has at most, so the driver may hold them."""
    t = F.col("t").cast("timestamp")
    days = F.sequence((t - F.make_dt_interval(secs=F.lit(before_s))).cast("date"), (t + F.make_dt_interval(secs=F.lit(after_s))).cast("date"))
    return sorted(str(r[0]) for r in times.filter("t is not null").select(F.explode(days)).distinct().collect())


def spans_of(times: DataFrame, *spans: tuple[float, float]) -> list[list[str]]:
    """days_of for several (before_s, after_s), found in one pass."""
    t = F.col("t").cast("timestamp")
    days = lambda a, b: F.sequence((t - F.make_dt_interval(secs=F.lit(a))).cast("date"), (t + F.make_dt_interval(secs=F.lit(b))).cast("date"))
    told = lambda k: lambda d: F.struct(F.lit(k).alias("k"), d.alias("d"))
    each = F.explode(F.flatten(F.array(*[F.transform(days(a, b), told(k)) for k, (a, b) in enumerate(spans)])))
    found = [r["x"] for r in times.filter("t is not null").select(each.alias("x")).distinct().collect()]
    return [sorted(str(x["d"]) for x in found if x["k"] == k) for k in range(len(spans))]


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64(*EVENT_KEY), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Store:
    """Tables under one folder: events, weapons, clusters, hotspots (by day), keys (by bucket of their hash), names, rejects and runs.

    * A batch of a feed writes its rows to folders of its own, `<table>/day=D/feed=F/batch=N`, and never those of another. Rows carry the batch's version, a running number; readers take the last version of a key.
      A batch that runs again first takes away what it left.
    * A report's key says its day in `keys`. If a revision moves a report to another day, a row that says so (gone) takes its place in the old one, so a day can be read alone.
    * `compact` writes a day that has many folders as one, with the last version of each key. Versions make that safe to break off: rows that stand in the old and the new folder are the same.
    * One process writes, one batch at a time (`lock`), whatever the number of streams.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    lock: threading.RLock = field(default_factory=threading.RLock, compare=False, repr=False)
    state: dict = field(default_factory=dict, compare=False, repr=False)

    def folder(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{table}"

    def found(self, path: str) -> tuple[JavaObject, JavaObject]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def folders(self, pattern: str) -> list[JavaObject]:
        fs, p = self.found(pattern)
        return [s.getPath() for s in fs.globStatus(p) or []]

    def begin(self, feed: str, batch: int) -> int:
        """The version of a batch: one more than the last. Leftovers of a run of it that didn't end go."""
        fs, mark = self.found(f"{self.folder('started')}/{feed}-{batch}")
        if fs.exists(mark):
            for table in ("events", "weapons", "clusters", "hotspots", "keys", "names", "rejects", "runs"):
                part = "*/" if table in BY else ""
                for p in self.folders(f"{self.folder(table)}/{part}feed={feed}/batch={batch}"):
                    fs.delete(p, True)
        else:
            fs.mkdirs(mark)
            for p in self.folders(f"{self.folder('started')}/{feed}-*"):
                if p.getName() != mark.getName():
                    fs.delete(p, True)  # what came before it is over
        if "version" not in self.state:
            self.state["version"] = self.last_version()
        self.state["version"] += 1
        return self.state["version"]

    def write(self, table: str, rows: DataFrame, feed: str, batch: int, version: int) -> None:
        """rows of a table that is cut by day or bucket have that column."""
        own = rows.withColumns({"version": F.lit(version).cast("long"), "feed": F.lit(feed), "batch": F.lit(batch).cast("long")})
        by = [BY[table]] if table in BY else []
        own = own.repartition(*by) if by else own.coalesce(1) if table in ("runs", "names") else own
        own.write.partitionBy(*by, "feed", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder(table))

    def write_failure(self, feed: str, error: str) -> None:
        """A run that failed. It has a folder of its own, so the run that takes its place doesn't hide it."""
        with self.lock:
            version = self.state["version"] = self.state.get("version", self.last_version()) + 1
            nothing = {c: F.lit(None).cast("long") for c in ("fetched", "normalized", "dropped", "new_records")}
            row = self.spark.range(1).select(F.lit(feed).alias("source"), *[v.alias(c) for c, v in nothing.items()], F.lit(False).alias("ok"), F.lit(error).alias("error"))
            self.write("runs", row, feed, -version, version)

    def begun(self, table: str) -> bool:
        """Whether a table has any folder: where it has none, what a batch would read of it needn't be found out."""
        fs, p = self.found(self.folder(table))
        return fs.exists(p)

    def last_version(self) -> int:
        runs = self.rows("runs")
        return 0 if runs is None else runs.agg(F.max("version")).first()[0] or 0

    def rows(self, table: str, parts: Iterable | None = None) -> DataFrame | None:
        """All versions of rows, of some days or buckets if they are given: only their folders are looked at."""
        root = self.folder(table)
        paths = [root]
        if parts is not None:
            fs, _ = self.found(root)
            paths = [p for p in (f"{root}/{BY[table]}={x}" for x in parts) if fs.exists(self.found(p)[1])]
            if not paths:
                return None
        try:
            return self.spark.read.option("basePath", root).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def latest(self, table: str, parts: Iterable | None = None) -> DataFrame | None:
        """The last version of each key."""
        found = self.rows(table, parts)
        if found is None:
            return None
        if KEY[table] is None:
            return found.drop("version", "feed", "batch")
        return last_versions(found, table).drop("version", "feed", "batch", "gone")

    def events(self, days: Iterable | None = None) -> DataFrame | None:
        return self.latest("events", days)

    def clusters(self, days: Iterable | None = None) -> DataFrame | None:
        return self.latest("clusters", days)

    def weapons(self, days: Iterable | None = None) -> DataFrame | None:
        return self.latest("weapons", days)

    def hotspots(self, days: Iterable | None = None) -> DataFrame | None:
        return self.latest("hotspots", days)

    def vocabulary(self) -> DataFrame | None:
        """Distinct names of actors that the curated feed has used."""
        names = self.rows("names")
        return None if names is None else names.select("name").distinct()

    def compact(self, table: str, most: int = MOST_FOLDERS) -> int:
        """Writes each day (or bucket) with more than `most` folders as one folder; returns how many. The newest batch of each feed stays apart, as it may run again."""
        with self.lock:
            fs, _ = self.found(self.folder(table))
            done = 0
            newest: dict[str, int] = {}
            for p in self.folders(f"{self.folder('started')}/*"):
                feed, _, batch = p.getName().rpartition("-")
                newest[feed] = max(newest.get(feed, -1), int(batch))
            for part in self.folders(f"{self.folder(table)}/{BY[table]}=*"):
                old = []
                for p in self.folders(f"{part.toString()}/feed=*/batch=*"):
                    feed, batch = p.getParent().getName().removeprefix("feed="), int(p.getName().removeprefix("batch="))
                    if feed == COMPACTED or batch < newest.get(feed, 1 << 62):
                        old.append(p)
                if len(old) <= most:
                    continue
                version = max((int(p.getName().removeprefix("batch=")) for p in old if p.getParent().getName() == f"feed={COMPACTED}"), default=-1) + 1
                rows = self.spark.read.option("basePath", self.folder(table)).parquet(*[p.toString() for p in old])
                rows = (rows.dropDuplicates() if KEY[table] is None else last_versions(rows, table, gone=True)).drop(BY[table], "feed", "batch")
                to = f"{part.toString()}/feed={COMPACTED}/batch={version}"
                rows.repartition(max(1, len(old) // 1_000)).write.mode("overwrite").parquet(to)
                for p in old:
                    fs.delete(p, True)
                    if not fs.listStatus(p.getParent()):
                        fs.delete(p.getParent(), True)
                done += 1
            return done


def last_versions(rows: DataFrame, table: str, gone: bool = False) -> DataFrame:
    """The row of the last version of each key; rows that say a report has gone from a day are left out, unless asked for."""
    order = [F.desc("version"), *([F.asc("gone")] if "gone" in rows.columns else [])]
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY[table]).orderBy(*order))).filter("_n = 1").drop("_n")
    return last if gone or "gone" not in rows.columns else last.filter("not gone")
