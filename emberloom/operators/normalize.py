"""Raw feed rows to unified events. Each normalizer gives (events, rejects); rows that aren't events, by design of the feed, are in neither."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_if_empty
from ..schema import EVENT, RADIUS_M

# Fixed values of the feeds' codes.
ACLED_SUB_EVENT = {
    "air/drone strike": "airstrike",
    "shelling/artillery/missile attack": "artillery",
    "remote explosive/landmine/ied": "ied",
    "suicide bomb": "ied",
    "grenade": "other_violence",
    "chemical weapon": "other_violence",
    "abduction/forced disappearance": "abduction",
    "armed clash": "ground_assault",
    "government regains territory": "ground_assault",
    "non-state actor overtakes territory": "ground_assault",
}
ACLED_EVENT = {
    "battles": "ground_assault",
    "explosions/remote violence": "artillery",
    "violence against civilians": "other_violence",
    "protests": "protest",
    "riots": "riot",
    "strategic developments": "non_kinetic",
}
ACLED_PRECISION = {1: "settlement", 2: "admin2", 3: "admin1"}
GDELT_AT = {
    "GLOBALEVENTID": 0, "SQLDATE": 1, "Actor1Name": 6, "Actor2Name": 16, "EventCode": 26, "EventBaseCode": 27, "EventRootCode": 28,
    "NumMentions": 31, "NumSources": 32, "NumArticles": 33, "ActionGeo_Type": 51, "ActionGeo_Fullname": 52, "ActionGeo_CountryCode": 53,
    "ActionGeo_Lat": 56, "ActionGeo_Long": 57, "DATEADDED": 59, "SOURCEURL": 60,
}
GDELT_ROOTS = ("18", "19", "20")
GDELT_CODES = (
    ("183", "ied"),
    ("181", "abduction"),
    ("193", "small_arms"),
    ("194", "artillery"),
    ("195", "airstrike"),
    ("196", "other_violence"),
    ("145", "riot"),
)
GDELT_PRECISION = {1: "country", 2: "admin1", 3: "settlement", 4: "settlement", 5: "admin1"}
UCDP_PRECISION = {1: "settlement", 2: "admin2", 3: "admin2", 4: "admin1", 5: "admin1", 6: "country", 7: "country"}
UCDP_LABEL = {1: "state-based conflict", 2: "non-state conflict", 3: "one-sided violence"}
UCDP_CATEGORY = {1: "ground_assault", 2: "ground_assault", 3: "other_violence"}


def lookup(table: dict, key: Column, default: str | None = None) -> Column:
    """table[key], or the default for keys that are null or unknown."""
    found = None
    for k, v in table.items():
        found = (F if found is None else found).when(key == k, v)
    return found.otherwise(F.lit(default))


def default_radius(precision: Column, radius: Column | None = None) -> Column:
    known = lookup(RADIUS_M, precision).cast("int")
    return known if radius is None else F.coalesce(radius, known)


def day(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def payload(rows: DataFrame) -> Column:
    """The raw row as JSON, nulls included: what a better parser would need."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})


def finish(df: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Splits off rows with a bad date or place; strict makes them an error when the events are computed."""
    good = F.coalesce(F.col("occurred_at").isNotNull() & on_earth(F.col("lat"), F.col("lon")), F.lit(False))
    reason = F.when(F.col("occurred_at").isNull(), "bad date").otherwise("place out of range")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields]
    if strict:
        checked = df.withColumn("lat", F.when(good, F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("row refused: "), reason)).cast("double")))
        return checked.select(*columns), df.filter(F.lit(False)).select("source", "source_event_id", reason.alias("reason"))
    return df.filter(good).select(*columns), df.filter(~good).select("source", "source_event_id", reason.alias("reason"))


def acled(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows without usable coordinates are no events."""
    sub, kind = F.lower(F.trim("sub_event_type")), F.lower(F.trim("event_type"))
    category = F.coalesce(lookup(ACLED_SUB_EVENT, sub), lookup(ACLED_EVENT, kind, "other_violence"))
    category = F.when((category == "airstrike") & F.coalesce(F.lower("tags").contains("drone"), F.lit(False)), "drone_strike").otherwise(category)
    precision = lookup(ACLED_PRECISION, F.expr("try_cast(geo_precision AS int)"), "admin2")
    text = lambda c: none_if_empty(F.col(c))
    out = rows.withColumns({"lat": F.expr("try_cast(latitude AS double)"), "lon": F.expr("try_cast(longitude AS double)")}).filter("lat is not null and lon is not null")
    out = out.select(
        F.lit("acled").alias("source"), F.col("event_id_cnty").alias("source_event_id"), day(F.col("event_date"), "yyyy-MM-dd").alias("occurred_at"), "lat", "lon",
        precision.alias("geo_precision"), default_radius(precision).alias("geo_radius_m"), text("country").alias("country"), text("admin1").alias("admin1"),
        text("location").alias("location_name"), category.alias("category"),
        F.concat(F.coalesce("event_type", F.lit("")), F.lit("/"), F.coalesce("sub_event_type", F.lit(""))).alias("raw_event_type"),
        text("actor1").alias("actor_a"), text("actor2").alias("actor_b"), F.expr("try_cast(fatalities AS int)").alias("fatalities"),
        F.lit(None).cast("string").alias("headline"), text("notes").alias("notes"), F.array().cast("array<string>").alias("source_urls"), payload(rows).alias("raw_payload"),
    )
    return finish(out, strict)


def gdelt_category(code: Column, root: Column) -> Column:
    """The first code whose beginning fits decides, then the root."""
    out = F.when(F.lit(False), "")
    for prefix, category in GDELT_CODES:
        out = out.when(code.startswith(prefix), category)
    return out.when(root == "19", "ground_assault").otherwise("other_violence")


def gdelt(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows has columns c0 to c60. Kept: roots 18 to 20 and codes from 145, if there is a place."""
    at = lambda name: F.col(f"c{GDELT_AT[name]}")
    code, root = F.trim(at("EventCode")), F.trim(at("EventRootCode"))
    out = rows.filter(at("SOURCEURL").isNotNull() | at("DATEADDED").isNotNull()).filter(root.isin(*GDELT_ROOTS) | code.startswith("145"))
    kind = F.coalesce(at("ActionGeo_Type").try_cast("int"), F.lit(1))
    out = out.withColumns({"lat": at("ActionGeo_Lat").try_cast("double"), "lon": at("ActionGeo_Long").try_cast("double"), "kind": kind}).filter("lat is not null and lon is not null and kind <> 0")
    name = none_if_empty(at("ActionGeo_Fullname"))
    parts = F.transform(F.split(name, ","), lambda x: F.trim(x))
    precision = lookup(GDELT_PRECISION, F.col("kind"), "country")
    url = F.trim(at("SOURCEURL"))
    nothing = F.lit(None).cast("string")
    out = out.select(
        F.lit("gdelt").alias("source"), at("GLOBALEVENTID").alias("source_event_id"), day(at("SQLDATE"), "yyyyMMdd").alias("occurred_at"), "lat", "lon",
        precision.alias("geo_precision"), default_radius(precision).alias("geo_radius_m"), F.element_at(parts, -1).alias("country"),
        F.when(F.size(parts) == 3, F.get(parts, 1)).alias("admin1"), F.get(parts, 0).alias("location_name"), gdelt_category(code, root).alias("category"),
        code.alias("raw_event_type"), none_if_empty(at("Actor1Name")).alias("actor_a"), none_if_empty(at("Actor2Name")).alias("actor_b"), F.lit(None).cast("int").alias("fatalities"),
        nothing.alias("headline"), nothing.alias("notes"), F.when(url != "", F.array(url)).otherwise(F.array().cast("array<string>")).alias("source_urls"), F.to_json(gdelt_map(), {"ignoreNullFields": "false"}).alias("raw_payload"),
    )
    return finish(out, strict)


def gdelt_payload(rows: DataFrame) -> DataFrame:
    """The named columns of each row as a map, for replays of a better parser."""
    return rows.select(F.col("c0").alias("source_event_id"), gdelt_map().alias("raw_payload"))


def gdelt_map() -> Column:
    return F.create_map(*[x for name, k in GDELT_AT.items() for x in (F.lit(name), F.col(f"c{k}"))])


def ucdp(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without coordinates, id or a date are no events."""
    violence = F.coalesce(F.col("type_of_violence").try_cast("int"), F.lit(0))
    precision = lookup(UCDP_PRECISION, F.coalesce(F.col("where_prec").try_cast("int"), F.lit(4)), "admin1")
    text = lambda c: none_if_empty(F.col(c))
    out = rows.select(
        F.lit("ucdp").alias("source"), F.col("id").cast("string").alias("source_event_id"), day(F.substring("date_start", 1, 10), "yyyy-MM-dd").alias("occurred_at"),
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), precision.alias("geo_precision"), default_radius(precision).alias("geo_radius_m"),
        text("country").alias("country"), text("adm_1").alias("admin1"), text("where_coordinates").alias("location_name"), lookup(UCDP_CATEGORY, violence, "other_violence").alias("category"),
        lookup(UCDP_LABEL, violence).alias("raw_event_type"), text("side_a").alias("actor_a"), text("side_b").alias("actor_b"), F.col("best").try_cast("int").alias("fatalities"),
        text("dyad_name").alias("headline"), text("source_headline").alias("notes"), F.array().cast("array<string>").alias("source_urls"), payload(rows).alias("raw_payload"),
    )
    return finish(out.filter("lat is not null and lon is not null and source_event_id is not null and occurred_at is not null"), strict=False)


def firms(rows: DataFrame) -> DataFrame:
    """Hotspots, never events: satellite, acquired_at, lat, lon, brightness, frp, confidence; rows without place or time go."""
    number = lambda c: F.col(c).try_cast("double")
    clock = F.when(F.length("acq_time") < 4, F.lpad("acq_time", 4, "0")).otherwise(F.col("acq_time"))
    out = rows.select(
        F.coalesce("satellite", F.lit("unknown")).alias("satellite"),
        day(F.concat_ws(" ", "acq_date", clock), "yyyy-MM-dd HHmm").alias("acquired_at"),
        number("latitude").alias("lat"),
        number("longitude").alias("lon"),
        F.coalesce(number("bright_ti4"), number("brightness")).alias("brightness"),
        number("frp").alias("frp"),
        "confidence",
    )
    return out.filter("acquired_at is not null and lat is not null and lon is not null")
