"""The query contract: lists, details, facets, hotspots, feed health, and coverage against the baseline feed."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_box, near_any, parse_box
from ..schema import CATEGORIES
from .score import evidence, explanation

EVENTS_LIMIT, EVENTS_MOST, HOTSPOTS_LIMIT, HOTSPOTS_MOST, FACETS = 2_000, 10_000, 5_000, 20_000, 300
EVENTS_DAYS, HOTSPOTS_DAYS = 14, 1
#: How many urls a card shows, and how many actors and weapons a filter offers.
URLS_SHOWN, ACTORS_SHOWN, WEAPONS_SHOWN = 12, 100, 10


@dataclass(frozen=True)
class EventQuery:
    """Filters of a list; what isn't set never reaches the plan."""

    now: datetime
    bbox: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    categories: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    actor: str | None = None
    weapons: tuple[str, ...] = ()
    min_reliability: float | None = None
    limit: int = EVENTS_LIMIT

    def __post_init__(self) -> None:
        if unknown := sorted(set(self.categories) - set(CATEGORIES)):
            raise ValueError(f"unknown categories: {', '.join(unknown)}")
        if self.actor is not None and len(self.actor) < 2:
            raise ValueError("actor takes two characters at least")
        if not 1 <= self.limit <= EVENTS_MOST:
            raise ValueError(f"limit is 1 to {EVENTS_MOST}")


def incident() -> Column:
    """One key for a cluster and for a report without one, so that members are found by an equi-join."""
    return F.coalesce(F.col("cluster_id"), -F.col("id"))


def members_with_actor(events: DataFrame, actor: str) -> DataFrame:
    """Incidents with a member whose actors, raw or canonical, contain the text; % and _ are wildcards."""
    pattern = f"%{actor.strip()}%"
    sides = [F.col(c).ilike(pattern) for c in ("actor_a", "actor_b", "actor_a_canonical", "actor_b_canonical") if c in events.columns]
    hit = sides[0]
    for s in sides[1:]:
        hit = hit | s
    return events.filter(F.coalesce(hit, F.lit(False))).select(incident().alias("_i")).distinct()


def actor_names(events: DataFrame) -> DataFrame:
    """(gram, name): every name of an actor, raw or canonical, by its runs of three characters in lower case. Made once over all events and kept, it is as large as their names are many."""
    columns = [c for c in ("actor_a", "actor_b", "actor_a_canonical", "actor_b_canonical") if c in events.columns]
    names = events.select(F.explode(F.array(*columns)).alias("name")).filter("name is not null").distinct()
    low = F.lower("name")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.substring(low, k, 3))
    return names.select(F.explode(F.array_distinct(grams)).alias("gram"), "name")


def names_like(names: DataFrame, actor: str) -> DataFrame:
    """The names of actor_names that contain the text; % and _ are wildcards. Names with all the text's runs of three are few, and only they are compared."""
    text = actor.strip()
    grams = sorted({x[k : k + 3] for x in re.split("[%_]", text.lower()) for k in range(len(x) - 2)})
    if not grams:
        return names.select("name").distinct().filter(F.col("name").ilike(f"%{text}%"))
    some = names.filter(F.col("gram").isin(grams)).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return some.select("name").filter(F.col("name").ilike(f"%{text}%"))


def members_named(events: DataFrame, found: DataFrame) -> DataFrame:
    """Incidents with a member whose actors, raw or canonical, are among some names."""
    columns = [c for c in ("actor_a", "actor_b", "actor_a_canonical", "actor_b_canonical") if c in events.columns]
    each = events.select(incident().alias("_i"), F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("name"))
    return each.join(found, "name", "left_semi").select("_i").distinct()


def members_with_weapon(events: DataFrame, weapons: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    hit = weapons.filter(F.col("weapon_key").isin(*keys)).select(F.col("event_id").alias("id"))
    return events.join(hit, "id", "left_semi").select(incident().alias("_i")).distinct()


def list_events(events: DataFrame, clusters: DataFrame, q: EventQuery, weapons: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Representatives and unclustered reports, latest first: light rows with place name, headline, inferred origin, and the cluster's member count and heat.

    names (actor_names), where kept, says which actors a text is found in without comparing it with every report's.
    """
    e = events.filter(F.col("occurred_at") >= F.lit(q.since or q.now - timedelta(days=EVENTS_DAYS)).cast("timestamp_ntz"))
    if q.until:
        e = e.filter(F.col("occurred_at") <= F.lit(q.until).cast("timestamp_ntz"))
    if q.categories:
        e = e.filter(F.col("category").isin(*q.categories))
    if q.countries:
        e = e.filter(F.lower("country").isin(*[c.lower() for c in q.countries]))
    if q.bbox:
        e = e.filter(in_box(F.col("lat"), F.col("lon"), parse_box(q.bbox)))
    if q.min_reliability is not None:
        e = e.filter(F.coalesce(F.col("reliability"), F.lit(0.0)) >= q.min_reliability)
    if q.actor:
        found = members_with_actor(events, q.actor) if names is None else members_named(events, names_like(names, q.actor))
        e = e.withColumn("_i", incident()).join(found, "_i", "left_semi").drop("_i")
    if q.weapons:
        if weapons is None:
            raise ValueError("the weapon filter takes the weapons table")
        e = e.withColumn("_i", incident()).join(members_with_weapon(events, weapons, q.weapons), "_i", "left_semi").drop("_i")
    c = clusters.select("cluster_id", "representative", "member_count", "thermal_corroborated")
    out = e.join(c, "cluster_id", "left").filter((F.col("representative") == F.col("id")) | F.col("cluster_id").isNull())
    kinds = {"location_name": "string", "headline": "string", "origin_lat": "double", "origin_lon": "double", "origin_country": "string", "origin_precision": "string", "origin_method": "string", "origin_confidence": "double"}
    light = ["id", "cluster_id", "source", "occurred_at", "lat", "lon", "geo_precision", "geo_radius_m", "country", "category", "actor_a", "fatalities", "reliability"]
    told = [F.col(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]  # events that weren't enriched have no origin
    out = out.select(*light, *told, F.coalesce("member_count", F.lit(1)).cast("long").alias("source_count"), F.coalesce("thermal_corroborated", F.lit(False)).alias("thermal_corroborated"))
    return out.orderBy(F.desc("occurred_at"), "id").limit(q.limit)


def event_members(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(event_id, id, source, occurred_at, fatalities, place): the members of each asked event's cluster in the order of time."""
    asked = ids.join(events.select(F.col("id").alias("event_id"), "cluster_id"), "event_id").filter("cluster_id is not null")
    m = asked.join(events.select("cluster_id", "id", "source", "occurred_at", "fatalities"), "cluster_id")
    return m.select("event_id", "id", "source", "occurred_at", "fatalities", F.row_number().over(Window.partitionBy("event_id").orderBy("occurred_at", "id")).alias("place"))


def event_payload(events: DataFrame, clusters: DataFrame, weapons: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Full payload of events: sources and urls over all members, the cluster's count, score and its explanation, weapons as an array."""
    asked = events.join(ids.select(F.col("event_id").alias("id")), "id", "left_semi") if ids is not None else events
    keys = asked.select("cluster_id").distinct()
    mates = events.join(keys, "cluster_id", "left_semi") if ids is not None else events.filter("cluster_id is not null")
    urls = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("source_urls") > 0, F.struct("id", "source_urls")))), lambda s: s["source_urls"])))
    c = clusters.select("cluster_id", "member_count", F.col("reliability").alias("cluster_reliability"), "thermal_corroborated")
    about = evidence(mates).join(mates.groupBy("cluster_id").agg(urls.alias("all_urls")), "cluster_id").join(c, "cluster_id")
    about = about.select("cluster_id", "sources", "all_urls", "member_count", "cluster_reliability", "thermal_corroborated", explanation(F.coalesce("thermal_corroborated", F.lit(False))).alias("reliability_explanation"))
    w = weapons.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("weapon_key", "display_name", "category", "confidence", "method", "evidence_span"))).alias("weapons"))
    out = asked.join(about, "cluster_id", "left").join(w, "id", "left")
    out = out.withColumns({"sources": F.coalesce("sources", F.array("source")), "source_urls": F.coalesce("all_urls", "source_urls"), "source_count": F.coalesce("member_count", F.lit(1)), "reliability": F.coalesce("cluster_reliability", F.lit(None).cast("double"))})
    return out.withColumn("thermal_corroborated", F.coalesce("thermal_corroborated", F.lit(False))).drop("all_urls", "member_count", "cluster_reliability")


def card(payload: DataFrame) -> DataFrame:
    """payload with the urls that a card shows, and how many more there are."""
    n = F.size("source_urls")
    return payload.withColumns({"shown_urls": F.slice("source_urls", 1, URLS_SHOWN), "more_urls": F.greatest(n - URLS_SHOWN, F.lit(0)).cast("long")})


def filter_options(events: DataFrame, weapons: DataFrame) -> DataFrame:
    """(kind, option, n): what the filters of a page offer, the first of the facets."""
    actors = actor_facet(events, ACTORS_SHOWN).select(F.lit("actor").alias("kind"), F.col("actor").alias("option"), "n")
    return actors.unionAll(weapon_facet(weapons).orderBy(F.desc("n"), "weapon_key").limit(WEAPONS_SHOWN).select(F.lit("weapon"), "weapon_key", "n"))


def country_facet(events: DataFrame, most: int = FACETS) -> DataFrame:
    found = events.filter("country is not null").groupBy("country").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "country").limit(most)


def actor_facet(events: DataFrame, most: int = FACETS) -> DataFrame:
    name = lambda c: F.coalesce(F.col(f"{c}_canonical"), F.col(c)) if f"{c}_canonical" in events.columns else F.col(c)
    names = events.select(F.explode(F.array(name("actor_a"), name("actor_b"))).alias("actor")).filter("actor is not null")
    return names.groupBy("actor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor").limit(most)


def weapon_facet(weapons: DataFrame) -> DataFrame:
    found = weapons.groupBy("weapon_key").agg(F.min("display_name").alias("display_name"), F.count_distinct("event_id").alias("n"))
    return found.orderBy(F.desc("n"), "weapon_key")


def list_hotspots(hotspots: DataFrame, now: datetime, since: datetime | None = None, bbox: str | None = None, limit: int = HOTSPOTS_LIMIT) -> DataFrame:
    if not 1 <= limit <= HOTSPOTS_MOST:
        raise ValueError(f"limit is 1 to {HOTSPOTS_MOST}")
    h = hotspots.filter(F.col("acquired_at") >= F.lit(since or now - timedelta(days=HOTSPOTS_DAYS)).cast("timestamp_ntz"))
    if bbox:
        h = h.filter(in_box(F.col("lat"), F.col("lon"), parse_box(bbox)))
    return h.orderBy(F.desc("acquired_at"), "id").limit(limit)


def baseline_months(events: DataFrame) -> DataFrame:
    """Months with baseline events."""
    return events.filter("source = 'ucdp'").select(F.date_format(F.date_trunc("month", "occurred_at"), "yyyy-MM").alias("month")).distinct().orderBy("month")


def in_month(month: str) -> Column:
    start = F.lit(f"{month}-01").cast("date")
    return (F.col("occurred_at") >= start.cast("timestamp_ntz")) & (F.col("occurred_at") < F.add_months(start, 1).cast("timestamp_ntz"))


BASELINE_RADIUS_M, DAY_S = 25_000.0, 86_400


def baseline_matches(events: DataFrame, month: str) -> DataFrame:
    """Baseline events of a month with `matched`: another feed has a report within 25 km and a day, ends included."""
    base = events.filter((F.col("source") == "ucdp") & in_month(month))
    probe = base.select("id", "lat", "lon", F.col("occurred_at").alias("t"))
    others = events.filter("source <> 'ucdp'").select("lat", "lon", F.col("occurred_at").alias("t"))
    hit = near_any(probe, others, "o_", BASELINE_RADIUS_M, DAY_S, DAY_S).select("id").distinct().withColumn("matched", F.lit(True))
    return base.join(hit, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def baseline_totals(events: DataFrame, month: str) -> DataFrame:
    """total, matched, match_rate and the incidents of the other feeds in the month; the rate is null without baseline events."""
    m = baseline_matches(events, month).agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"))
    n = events.filter((F.col("source") != "ucdp") & in_month(month)).agg(F.count_distinct(incident()).alias("pipeline_incidents"))
    rate = F.when(F.col("total") > 0, F.bround(F.col("matched") / F.col("total"), 3))
    return m.join(n, how="cross").select(F.lit(month).alias("month"), "total", "matched", rate.alias("match_rate"), "pipeline_incidents")  # one row each


#: Fixed value: what is said where there is nothing to compare with.
NO_BASELINE = "No baseline data yet."


def baseline_report(events: DataFrame, month: str | None = None) -> DataFrame:
    """One row: whether there is baseline data, the totals of a month (the latest with such data, if none is named), and all months with data."""
    if month is not None:
        datetime.strptime(month, "%Y-%m")  # raises for what is no month
    months = [r.month for r in baseline_months(events).collect()]  # as many as the calendar has
    spark = events.sparkSession
    if not months:
        return spark.range(1).select(F.lit(False).alias("available"), F.lit(NO_BASELINE).alias("note"), *[F.lit(None).cast(t).alias(c) for c, t in (("month", "string"), ("total", "long"), ("matched", "long"), ("match_rate", "double"), ("pipeline_incidents", "long"))], F.array().cast("array<string>").alias("months_with_data"))
    told = baseline_totals(events, month or months[-1])
    return told.select(F.lit(True).alias("available"), F.lit(None).cast("string").alias("note"), "month", "total", "matched", "match_rate", "pipeline_incidents", F.array(*[F.lit(m) for m in months]).alias("months_with_data"))


def baseline_by_country(events: DataFrame, month: str, most: int = 30) -> DataFrame:
    per = baseline_matches(events, month).groupBy(F.coalesce("country", F.lit("(unknown)")).alias("country")).agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"))
    return per.orderBy(F.desc("total"), "country").limit(most)


def feed_health(marks: DataFrame, credentials: DataFrame) -> DataFrame:
    """A row for each feed with a mark, and for each credential without one."""
    c = credentials.select(F.col("provider").alias("source"), F.col("status").alias("credential_status"))
    joined = marks.join(c, "source", "full_outer")
    return joined.withColumns({"consecutive_failures": F.coalesce("consecutive_failures", F.lit(0)), "records_ingested": F.coalesce("records_ingested", F.lit(0)).cast("long")})


def credentials_due(credentials: DataFrame, now: datetime, within: timedelta = timedelta(hours=2)) -> DataFrame:
    """Credentials to renew: they expire within the threshold or say nothing; static and dead ones aren't renewed."""
    soon = F.coalesce(F.col("access_expires_at") < F.lit(now + within).cast("timestamp_ntz"), F.lit(True))
    return credentials.filter((F.col("auth_type") != "static_key") & (F.col("status") != "dead") & soon).select("provider")
