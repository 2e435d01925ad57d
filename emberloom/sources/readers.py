"""Readers of landed feed files; each gives the raw rows that the normalizers take."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.gazetteer import ACTORS, COUNTRIES, WEAPONS

ACLED_COLUMNS = ("event_id_cnty", "event_date", "event_type", "sub_event_type", "actor1", "actor2", "country", "admin1", "location", "latitude", "longitude", "geo_precision", "fatalities", "notes", "tags")
UCDP_ROW = "id long, relid string, date_start string, date_end string, latitude double, longitude double, where_prec int, where_coordinates string, country string, adm_1 string, type_of_violence int, side_a string, side_b string, best int, dyad_name string, source_headline string"
FIRMS_COLUMNS = ("latitude", "longitude", "acq_date", "acq_time", "satellite", "bright_ti4", "brightness", "frp", "confidence")
GDELT_COLUMNS = 61

strings = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names])
GDELT_SCHEMA = strings([f"c{i}" for i in range(GDELT_COLUMNS)])


def read_acled(spark: SparkSession, path: str | list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Pages of JSON with their rows under `data`, one page a file; optionally the dates from since to until."""
    rows = spark.read.schema(T.StructType([T.StructField("data", T.ArrayType(strings(ACLED_COLUMNS)))])).option("multiLine", True).json(path)
    rows = rows.select(F.explode("data").alias("r")).select("r.*")
    return rows.filter(F.col("event_date").between(since, until)) if since and until else rows


def read_gdelt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated export files without header or quotes, unpacked when they landed; short lines have nulls."""
    return spark.read.schema(GDELT_SCHEMA).options(sep="\t", quote="", mode="PERMISSIVE").csv(path)


def stream_gdelt(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The same as a stream: the source's log of files takes the place of a comparison with the last file's stamp, so no file is missed."""
    reader = spark.readStream.schema(GDELT_SCHEMA).options(sep="\t", quote="")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).csv(path)


def newest_listing(listing: DataFrame) -> DataFrame:
    """The export files in a listing of lines `size hash url`: url and the stamp in its name."""
    parts = F.split("value", r"\s+")
    found = listing.filter((F.size(parts) == 3) & F.get(parts, 2).endswith(".export.CSV.zip")).select(F.get(parts, 2).alias("url"), *[c for c in listing.columns if c != "value"])
    return found.withColumn("stamp", F.try_to_timestamp(F.regexp_extract("url", r"(\d{14})\.export", 1), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def next_export(listing: DataFrame, since: datetime | None = None) -> DataFrame:
    """The first export file of a listing if it is later than the mark: url and stamp, one row or none. A listing without any is an error."""
    found = newest_listing(listing.withColumn("_k", F.monotonically_increasing_id())).orderBy("_k").select("url", "stamp").limit(1)
    if found.isEmpty():
        raise ValueError("the listing names no export file")
    return found if since is None else found.filter(F.col("stamp") > F.lit(since).cast("timestamp_ntz"))


def read_gdelt_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Export files as the feed packs them, one file of lines in each archive; undecodable bytes are replaced. An archive is unpacked in one task, and they are small by the feed's cadence."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    lines = z.read(z.namelist()[0]).decode("utf-8", errors="replace").splitlines()
                cells = [(x.split("\t") + [None] * GDELT_COLUMNS)[:GDELT_COLUMNS] for x in lines if x]
                yield pd.DataFrame(cells, columns=GDELT_SCHEMA.names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, GDELT_SCHEMA)


#: How far back a first read of the baseline feed goes, and how far before its mark each later one begins, in days.
UCDP_FIRST_DAYS, UCDP_OVERLAP_DAYS = 365, 45


def ucdp_start(now: datetime, watermark: datetime | None = None) -> date:
    """The first date to ask the baseline feed for."""
    return ((now - timedelta(days=UCDP_FIRST_DAYS)) if watermark is None else (watermark - timedelta(days=UCDP_OVERLAP_DAYS))).date()


def since_date(rows: DataFrame, start: date) -> DataFrame:
    """The baseline feed's rows from a date on; rows without one stay, for the normalizer to refuse."""
    at = F.try_to_timestamp(F.substring("date_start", 1, 10), F.lit("yyyy-MM-dd"))
    return rows.filter(F.coalesce(at.cast("date") >= F.lit(start), F.lit(True)))


def read_firms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with a header, all data sets together; columns that one of them lacks are null."""
    read = [spark.read.option("header", True).csv(p) for p in paths]
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in FIRMS_COLUMNS])


def stream_firms(spark: SparkSession, path: str, columns: tuple[str, ...] = FIRMS_COLUMNS) -> DataFrame:
    """Landed CSV files of one data set as a stream; columns are those that its files have, in their order, the others are null."""
    rows = spark.readStream.schema(strings(columns)).option("header", True).csv(path)
    return rows.select(*[F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in FIRMS_COLUMNS])


def read_ucdp(spark: SparkSession, path: str | list[str], most_pages: int = 200) -> DataFrame:
    """Pages of JSON with their rows under `Result`; more pages than the limit are an error, not a truncation."""
    pages = spark.read.schema(f"TotalPages int, Result array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in UCDP_ROW.split(','))}>>").option("multiLine", True).json(path)
    if (pages.agg(F.max("TotalPages")).first()[0] or 0) > most_pages:
        raise ValueError(f"more than {most_pages} pages")
    return pages.select(F.explode("Result").alias("r")).select("r.*")


def ucdp_watermark(rows: DataFrame) -> DataFrame:
    """The latest start date as the new high-water mark."""
    return rows.agg(F.max(F.try_to_timestamp(F.substring("date_start", 1, 10), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")).alias("watermark"))


def weapons_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, c, list(a)) for k, n, c, a in WEAPONS], "key string, display_name string, category string, aliases array<string>")


def actors_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACTORS.items()), "alias string, canonical string")


def countries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in COUNTRIES.items()], "name string, lat double, lon double")
