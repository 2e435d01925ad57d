"""Views of the driver's tables in the shape of the event model.

The expressions are in the dialect that Spark and DuckDB share, integers and explicit doubles only, so the SQL that queries are held against uses the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
MONTH = "2024-01"
DAY = "CASE WHEN event_id % 5 = 0 THEN ts ELSE CAST(CAST(ts AS DATE) AS {ts}) END"
LAT = "CAST(-60 + 5 * (user_id % 25) AS DOUBLE) + CAST((event_id * 37{a}) % 201 - 100 AS DOUBLE) / CAST(2000 AS DOUBLE)"
LON = "CAST(-170 + 14 * (user_id % 25) AS DOUBLE) + CAST((event_id * 53{a}) % 201 - 100 AS DOUBLE) / CAST(2000 AS DOUBLE)"
ALIASES = "CASE {k} % 44 WHEN 0 THEN ' near Iskander-M site' WHEN 11 THEN ' hit by HIMARS' WHEN 22 THEN ' FPV drones over' WHEN 33 THEN ' Grad rockets' ELSE '' END"

EVENTS = {
    "id": "event_id",
    "source": "CASE event_id % 4 WHEN 0 THEN 'acled' WHEN 3 THEN 'ucdp' ELSE 'gdelt' END",
    "source_event_id": "CAST(event_id AS STRING)",
    "occurred_at": DAY,
    "lat": LAT.format(a=""),
    "lon": LON.format(a=""),
    "geo_precision": "CASE event_id % 7 WHEN 5 THEN 'admin2' WHEN 6 THEN 'admin1' ELSE 'settlement' END",
    "geo_radius_m": "CAST(CASE event_id % 7 WHEN 5 THEN 25000 WHEN 6 THEN 60000 ELSE 5000 END AS INT)",
    "country": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE n_name END",
    "category": "CASE event_type WHEN 'error' THEN 'airstrike' WHEN 'purchase' THEN 'artillery' WHEN 'click' THEN 'protest' WHEN 'view' THEN 'ground_assault' ELSE 'ied' END",
    "actor_a": "CONCAT('Actor', CAST(user_id % 6 AS STRING))",
    "actor_b": "CAST(NULL AS STRING)",
    "fatalities": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(FLOOR(value) AS INT) % 40 END",
    "headline": "CAST(NULL AS STRING)",
    "notes": "CONCAT(props, " + ALIASES.format(k="event_id") + ")",
    "url": "CASE WHEN event_id % 4 IN (1, 2) THEN CONCAT('https://www.news', CAST(event_id % 9 AS STRING), '.example.com/', CAST(event_id AS STRING)) END",
    "reliability": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END",
}
HOTSPOTS = {
    "id": "event_id",
    "satellite": "CASE event_id % 20 WHEN 3 THEN 'N20' ELSE 'NPP' END",
    "acquired_at": "ts",
    "lat": LAT.format(a=" + 11"),
    "lon": LON.format(a=" + 7"),
    "frp": "value",
}
NOTES = {"id": "doc_id", "notes": "CONCAT(text, " + ALIASES.format(k="doc_id") + ")"}
#: Clusters without the work of clustering: four neighbours by id, every seventh report alone.
CLUSTER = "CASE WHEN id % 7 = 0 THEN NULL ELSE id - id % 4 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e.format(ts="TIMESTAMP_NTZ") if "{ts}" in e else e).alias(n) for n, e in columns.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with the names of nations, of which there are 25 by definition."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = table(spark, sf_dir, "events").join(F.broadcast(n), F.col("user_id") % 25 == F.col("n_nationkey"), "left")
    out = select(joined, EVENTS)
    return out.withColumn("source_urls", F.when(F.col("url").isNotNull(), F.array("url")).otherwise(F.array().cast("array<string>"))).drop("url")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "events"), HOTSPOTS)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents as notes, some with a weapon's name at the end."""
    return select(table(spark, sf_dir, "documents"), NOTES)


def sql_columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.format(ts='TIMESTAMP') if '{ts}' in e else e} AS {n}" for n, e in columns.items())


EVENTS_SQL = (
    f"ev AS (SELECT {sql_columns(EVENTS)} FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey)"
)
HOTSPOTS_SQL = f"hs AS (SELECT {sql_columns(HOTSPOTS)} FROM events)"
NOTES_SQL = f"nt AS (SELECT {sql_columns(NOTES)} FROM documents)"

# Raw feed rows, as the feeds send them: strings with the faults that feeds have.
ACLED_RAW = {
    "event_id_cnty": "CONCAT('A', CAST(event_id AS STRING))",
    "event_date": "CASE WHEN event_id % 53 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) END",
    "event_type": "CASE event_id % 7 WHEN 0 THEN 'Battles' WHEN 1 THEN 'Explosions/Remote violence' WHEN 2 THEN 'Violence against civilians' WHEN 3 THEN 'Protests' WHEN 4 THEN ' Riots ' WHEN 5 THEN 'Strategic developments' ELSE 'Other' END",
    "sub_event_type": "CASE event_id % 9 WHEN 0 THEN 'Air/drone strike' WHEN 1 THEN 'Shelling/artillery/missile attack' WHEN 2 THEN 'Grenade' WHEN 3 THEN 'Armed clash' WHEN 4 THEN NULL ELSE 'Peaceful' END",
    "actor1": "CASE WHEN event_id % 10 = 0 THEN '' ELSE CONCAT('Actor', CAST(user_id % 6 AS STRING)) END",
    "actor2": "CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Civilians' END",
    "country": "CONCAT('Country', CAST(user_id % 25 AS STRING))",
    "admin1": "''",
    "location": "CONCAT('Town', CAST(event_id % 40 AS STRING))",
    "latitude": "CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '91' ELSE CAST(user_id % 80 AS STRING) END",
    "longitude": "CASE WHEN event_id % 41 = 0 THEN 'east' ELSE CAST(event_id % 170 AS STRING) END",
    "geo_precision": "CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '9' ELSE 'x' END",
    "fatalities": "CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(event_id % 12 AS STRING) END",
    "notes": "props",
    "tags": "CASE WHEN event_id % 4 = 0 THEN 'Drone used' ELSE NULL END",
}
GDELT_RAW = {f"c{i}": "''" for i in range(61)} | {
    "c0": "CAST(event_id AS STRING)",
    "c1": "REPLACE(CAST(CAST(ts AS DATE) AS STRING), '-', '')",
    "c6": "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'MILITARY' END",
    "c16": "'CIVILIAN'",
    "c26": "CASE event_id % 12 WHEN 0 THEN '1831' WHEN 1 THEN '181' WHEN 2 THEN '193' WHEN 3 THEN '194' WHEN 4 THEN '195' WHEN 5 THEN '196' WHEN 6 THEN '1451' WHEN 7 THEN '190' WHEN 8 THEN '200' WHEN 9 THEN '0231' WHEN 10 THEN ' 1822 ' ELSE '141' END",
    "c28": "CASE event_id % 12 WHEN 0 THEN '18' WHEN 1 THEN '18' WHEN 6 THEN '14' WHEN 8 THEN '20' WHEN 9 THEN '02' WHEN 10 THEN '18' WHEN 11 THEN '14' ELSE '19' END",
    "c51": "CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(event_id % 6 AS STRING) END",
    "c52": "CASE event_id % 4 WHEN 0 THEN 'Oldtown, North, Landia' WHEN 1 THEN 'North, Landia' WHEN 2 THEN 'Landia' ELSE '' END",
    "c56": "CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(user_id % 80 AS STRING) END",
    "c57": "CAST(event_id % 170 AS STRING)",
    "c59": "'x'",
    "c60": "CASE WHEN event_id % 5 = 0 THEN ' ' ELSE CONCAT('https://www.news', CAST(event_id % 9 AS STRING), '.example.com/a') END",
}
UCDP_RAW = {
    "id": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id END",
    "date_start": "CASE WHEN event_id % 23 = 0 THEN 'unknown' ELSE CONCAT(CAST(CAST(ts AS DATE) AS STRING), 'T00:00:00') END",
    "latitude": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(user_id % 80 AS DOUBLE) END",
    "longitude": "CAST(event_id % 170 AS DOUBLE)",
    "where_prec": "CASE WHEN event_id % 9 = 8 THEN NULL ELSE CAST(event_id % 9 AS INT) END",
    "where_coordinates": "'spot'",
    "country": "''",
    "adm_1": "'Region'",
    "type_of_violence": "CAST(event_id % 5 AS INT)",
    "side_a": "'Government'",
    "side_b": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Rebels' END",
    "best": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 30 AS INT) END",
    "dyad_name": "'Government - Rebels'",
    "source_headline": "props",
}
FIRMS_RAW = {
    "latitude": "CAST(user_id % 80 AS STRING)",
    "longitude": "CASE WHEN event_id % 21 = 0 THEN '' ELSE CAST(event_id % 170 AS STRING) END",
    "acq_date": "CAST(CAST(ts AS DATE) AS STRING)",
    "acq_time": "CASE WHEN event_id % 33 = 0 THEN '9999' ELSE CAST(event_id % 60 AS STRING) END",
    "satellite": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'N20' END",
    "bright_ti4": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 400 AS STRING) END",
    "brightness": "'300'",
    "frp": "CASE WHEN event_id % 8 = 0 THEN 'n' ELSE CAST(event_id % 50 AS STRING) END",
    "confidence": "'nominal'",
}


def raw(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return select(table(spark, sf_dir, "events"), columns)


def raw_sql(columns: dict[str, str]) -> str:
    return f"raw AS (SELECT {sql_columns(columns)} FROM events)"


# Feed marks and credentials: a few rows from the region table.
MARKS = {
    "source": "CONCAT('feed', CAST(r_regionkey AS STRING))",
    "watermark": "CASE WHEN r_regionkey = 2 THEN NULL ELSE TIMESTAMP{n} '2024-01-01 00:00:00' END",
    "last_success_at": "TIMESTAMP{n} '2024-01-02 00:00:00'",
    "last_attempt_at": "TIMESTAMP{n} '2024-01-02 00:00:00'",
    "last_error": "CASE WHEN r_regionkey = 1 THEN 'old error' END",
    "consecutive_failures": "CAST(r_regionkey AS INT)",
    "records_ingested": "CAST(10 * r_regionkey AS BIGINT)",
}
RUNS = {
    "source": "CONCAT('feed', CAST(r_regionkey + 1 AS STRING))",
    "ok": "r_regionkey % 2 = 0",
    "at": "TIMESTAMP{n} '2024-01-03 00:00:00'",
    "watermark": "CASE WHEN r_regionkey = 2 THEN TIMESTAMP{n} '2024-01-03 00:00:00' END",
    "new_records": "CAST(5 AS BIGINT)",
    "error": "'failed: timeout'",
}
CREDENTIALS = {
    "provider": "CONCAT('feed', CAST(r_regionkey + 2 AS STRING))",
    "auth_type": "CASE WHEN r_regionkey = 0 THEN 'static_key' ELSE 'oauth' END",
    "status": "CASE WHEN r_regionkey = 1 THEN 'dead' ELSE 'ok' END",
    "access_expires_at": "CASE r_regionkey WHEN 2 THEN NULL WHEN 3 THEN TIMESTAMP{n} '2024-01-31 01:30:00' ELSE TIMESTAMP{n} '2024-01-31 06:00:00' END",
}


def small(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "region").select(*[F.expr(e.replace("TIMESTAMP{n}", "TIMESTAMP_NTZ")).alias(n) for n, e in columns.items()])


def small_sql(name: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e.replace('{n}', '')} AS {n}' for n, e in columns.items())} FROM region)"
