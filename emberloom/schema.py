"""Schemas, domains and fixed values of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

# What results must agree on.
CATEGORIES = (
    "airstrike", "drone_strike", "missile_strike", "artillery", "ied", "ground_assault", "small_arms",
    "naval", "protest", "riot", "abduction", "other_violence", "non_kinetic",
)
KINETIC = ("airstrike", "drone_strike", "missile_strike", "artillery", "ied", "ground_assault", "naval")
STRIKES = ("airstrike", "drone_strike", "missile_strike")
#: Best first.
PRECISIONS = ("exact", "settlement", "admin2", "admin1", "country")
RADIUS_M = {"exact": 1_000, "settlement": 5_000, "admin2": 25_000, "admin1": 60_000, "country": 250_000}
#: Categories that share a group are compatible.
COMPATIBLE = (
    ("airstrike", "drone_strike", "missile_strike", "artillery"),
    ("ied", "other_violence"),
    ("ground_assault", "small_arms", "other_violence"),
    ("protest", "riot"),
    ("abduction", "other_violence"),
    ("naval", "missile_strike"),
)
#: Which member speaks for a cluster.
SOURCE_TIER = {"acled": 1.0, "ucdp": 0.9, "gdelt": 0.4, "firms": 0.0}
OTHER_TIER = 0.2
#: Where a reliability score starts, and what adds to it.
BASE_SCORE = {"acled": 0.70, "ucdp": 0.70, "gdelt": 0.35}
OTHER_SCORE = 0.2
PRECISION_BONUS = {"exact": 0.05, "settlement": 0.05, "admin2": 0.02}
THERMAL_BONUS, DOMAIN_STEP, DOMAIN_CAP, CONSISTENCY = 0.15, 0.05, 0.15, 0.05
SEVERITY = {
    "missile_strike": 1.0, "airstrike": 0.95, "drone_strike": 0.9, "artillery": 0.8, "ied": 0.8, "ground_assault": 0.7, "naval": 0.7,
    "small_arms": 0.55, "abduction": 0.5, "riot": 0.35, "other_violence": 0.4, "protest": 0.2, "non_kinetic": 0.1,
}

EVENT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("geo_precision", T.StringType()),
        T.StructField("geo_radius_m", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("admin1", T.StringType()),
        T.StructField("location_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("raw_event_type", T.StringType()),
        T.StructField("actor_a", T.StringType()),
        T.StructField("actor_b", T.StringType()),
        T.StructField("fatalities", T.IntegerType()),
        T.StructField("headline", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("source_urls", T.ArrayType(T.StringType())),
        T.StructField("raw_payload", T.StringType()),
    ]
)
#: Identity of a report, and what a revision of it may change.
EVENT_KEY = ("source", "source_event_id")
REVISED = tuple(f.name for f in EVENT.fields if f.name not in EVENT_KEY)
HOTSPOT_KEY = ("satellite", "acquired_at", "lat", "lon")
