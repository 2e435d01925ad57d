"""Feeds as data sources that Spark reads page by page, as a batch or a stream, over a function that fetches a page.

`spark.dataSource.register(acled_source(fetch, clock))`, then `spark.read.format("acled").option("until", "2024-03-05").load()` or `spark.readStream.format("acled").load()`. What fetches is the user's: a session with
its credentials, or recorded pages. It travels to the workers, where pages are read; the driver learns only what parts there are.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .readers import ACLED_COLUMNS, FIRMS_COLUMNS, GDELT_COLUMNS, UCDP_ROW, ucdp_start

#: Rows of a page, the most pages of both paged feeds, how far back the curated feed is read again, and the data sets of hotspots.
ACLED_PAGE, UCDP_PAGE, ACLED_MOST_PAGES, MOST_PAGES, ACLED_WINDOW_DAYS = 5_000, 1_000, 40, 200, 14
FIRMS_DATASETS = ("VIIRS_SNPP_NRT", "VIIRS_NOAA20_NRT")
EXPORT = re.compile(r"(\d{14})\.export\.CSV\.zip$")
#: fetch(params) gives a page: parsed JSON, text or bytes, as the feed has it; it raises what goes wrong.
Fetch = Callable[[dict[str, Any]], Any]
Clock = Callable[[], datetime]


@dataclass
class Part(InputPartition):
    """What one task reads."""

    what: dict[str, Any]


def feed_source(feed: str, ddl: str, latest: Callable[[dict[str, str]], dict], parts: Callable[[dict, dict], list[dict]], read: Callable[[dict], Iterator[tuple]]) -> type[DataSource]:
    """A data source from three functions: the newest offset, the parts between two offsets (the first is empty at the beginning), and the rows of a part.

    A batch reads from the beginning, or the option `since`, to the option `until` or now.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            start = {"at": self.options["since"]} if "since" in self.options else {}
            return [Part(p) for p in parts(start, latest(self.options))] or [Part({})]

        def read(self, partition: Part) -> Iterator[tuple]:
            return read(partition.what) if partition.what else iter(())

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def initialOffset(self) -> dict:  # noqa: N802
            return {}

        def latestOffset(self) -> dict:  # noqa: N802
            return latest(self.options)

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Part(p) for p in parts(start, end)] or [Part({})]

        def read(self, partition: Part) -> Iterator[tuple]:
            return read(partition.what) if partition.what else iter(())

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return feed

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:  # noqa: ARG002
            return Reader(dict(self.options))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802, ARG002
            return StreamReader(dict(self.options))

    return Source


def text_of(value: Any) -> str | None:
    return None if value is None else str(value)


def until(options: dict[str, str], clock: Clock) -> str:
    return options.get("until") or clock().isoformat(timespec="seconds")


def acled_source(fetch: Fetch, clock: Clock, window_days: int = ACLED_WINDOW_DAYS, page_rows: int = ACLED_PAGE, most_pages: int = ACLED_MOST_PAGES, days_each: int = 5) -> type[DataSource]:
    """The curated feed: every read pulls the trailing window again, as its records are revised. A task reads a few days, page by page up to the first short page; more than most_pages are an error."""

    def parts(start: dict, end: dict) -> list[dict]:
        last = datetime.fromisoformat(end["at"]).date()
        first = last - timedelta(days=window_days)
        if "at" in start and len(start["at"]) == 10:  # a batch since a date
            first = date.fromisoformat(start["at"])
        days = range(0, (last - first).days + 1, days_each)
        return [{"since": str(first + timedelta(days=k)), "until": str(min(first + timedelta(days=k + days_each - 1), last))} for k in days]

    def read(part: dict) -> Iterator[tuple]:
        for page in range(1, most_pages + 1):
            rows = fetch({"event_date": f"{part['since']}|{part['until']}", "event_date_where": "BETWEEN", "limit": page_rows, "page": page}).get("data") or []
            for r in rows:
                yield tuple(text_of(r.get(c)) for c in ACLED_COLUMNS)
            if len(rows) < page_rows:
                return
        raise RuntimeError(f"acled: more than {most_pages} pages from {part['since']} to {part['until']}")

    return feed_source("acled", ", ".join(f"{c} string" for c in ACLED_COLUMNS), lambda o: {"at": until(o, clock)}, parts, read)


def ucdp_source(fetch: Fetch, clock: Clock, mark: Callable[[], datetime | None] = lambda: None, page_rows: int = UCDP_PAGE, most_pages: int = MOST_PAGES) -> type[DataSource]:
    """The baseline feed: from a while before the mark, the latest start date stored, or a year back. The first page says how many there are, and each is a task's; more than most_pages are an error, not a truncation."""
    fields = [f.strip().split(" ") for f in UCDP_ROW.split(",")]
    kinds = {"long": int, "int": int, "double": float, "string": str}

    def value(v: Any, kind: str) -> Any:
        try:
            return None if v is None else kinds[kind](v)
        except (TypeError, ValueError):
            return None

    def params(day: str, page: int) -> dict:
        return {"pagesize": page_rows, "page": page, "StartDate": day}

    def latest(options: dict[str, str]) -> dict:
        seen = mark()
        return {"at": until(options, clock), "mark": seen.isoformat(timespec="seconds") if seen else ""}

    def parts(start: dict, end: dict) -> list[dict]:
        day = str(start["at"]) if len(start.get("at", "")) == 10 else str(ucdp_start(datetime.fromisoformat(end["at"]), datetime.fromisoformat(end["mark"]) if end["mark"] else None))
        pages = int(fetch(params(day, 0)).get("TotalPages") or 0)
        if pages > most_pages:
            raise RuntimeError(f"ucdp: more than {most_pages} pages from {day}")
        return [{"day": day, "page": k} for k in range(max(pages, 1))]

    def read(part: dict) -> Iterator[tuple]:
        for r in fetch(params(part["day"], part["page"])).get("Result") or []:
            yield tuple(value(r.get(name), kind) for name, kind in fields)

    return feed_source("ucdp", UCDP_ROW, latest, parts, read)


def firms_source(fetch: Fetch, clock: Clock, datasets: tuple[str, ...] = FIRMS_DATASETS) -> type[DataSource]:
    """Hotspots of the last day: CSV text for each data set, each a task's; columns that one lacks are null."""

    def read(part: dict) -> Iterator[tuple]:
        for r in csv.DictReader(io.StringIO(fetch(part))):
            yield tuple(r.get(c) for c in FIRMS_COLUMNS)

    return feed_source("firms", ", ".join(f"{c} string" for c in FIRMS_COLUMNS), lambda o: {"at": until(o, clock)}, lambda start, end: [{"dataset": d} for d in datasets], read)


def gdelt_source(fetch: Fetch) -> type[DataSource]:
    """The export file that a listing names first, if it is later than the last one read: fetch({"listing": True}) gives lines `size hash url`, fetch({"url": url}) a packed file. A listing without any is an error."""

    def latest(options: dict[str, str]) -> dict:  # noqa: ARG001
        for line in fetch({"listing": True}).splitlines():
            cells = line.split()
            if len(cells) == 3 and (m := EXPORT.search(cells[2])):
                return {"stamp": m[1], "url": cells[2]}
        raise ValueError("the listing names no export file")

    def read(part: dict) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(fetch(part))) as z:
            for line in z.read(z.namelist()[0]).decode("utf-8", errors="replace").splitlines():
                if line:
                    yield tuple((line.split("\t") + [None] * GDELT_COLUMNS)[:GDELT_COLUMNS])

    def parts(start: dict, end: dict) -> list[dict]:
        return [{"url": end["url"]}] if end["stamp"] > start.get("stamp", "") else []

    return feed_source("gdelt", ", ".join(f"c{k} string" for k in range(GDELT_COLUMNS)), latest, parts, read)
