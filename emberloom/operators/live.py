"""What a live display asks: priorities, replay windows, and what a camera sees."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.geo import angle_deg, great_circle, seconds
from ..schema import SEVERITY
from .cluster import checkpoint
from .normalize import lookup

QUEUE_DEPTH = 50
#: Fixed values of the display.
KM_PER_DEGREE, LEAST_DEG, UNKNOWN_RADIUS_M = 111.0, 0.12, 10_000
VISIBLE_DEG, VISIBLE_DEG_BY_ALTITUDE = 22.0, 38.0
SPANS_H, STEP_MIN = (6, 24, 72, 168, 336), 36
BASE_DWELL_MS, MOST_DWELL_MS, DWELL_MS_EACH = 8_000, 15_000, 250


def age_minutes(now: Column) -> Column:
    return F.greatest((seconds(now) - seconds(F.col("occurred_at"))) / 60, F.lit(0.0))


def priority(now: Column) -> Column:
    """Newness, deaths, reliability and severity."""
    severity = F.coalesce(lookup(SEVERITY, F.col("category")).cast("double"), F.lit(0.4))
    deaths = F.least(F.coalesce("fatalities", F.lit(0)) / F.lit(20.0), F.lit(1.0))
    return 0.3 * F.exp(-age_minutes(now) / 1440) + 0.25 * deaths + 0.2 * F.coalesce("reliability", F.lit(0.3)) + 0.25 * severity


def live_queue(events: DataFrame, now: datetime, depth: int = QUEUE_DEPTH) -> DataFrame:
    """The events of highest priority, each once, the latest state of it."""
    moment = F.lit(now).cast("timestamp_ntz")
    once = events.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("occurred_at")))).filter("_n = 1").drop("_n")
    return once.withColumn("priority", F.round(priority(moment), 9)).orderBy(F.desc("priority"), "id").limit(depth)


def queue_stream(events: DataFrame, depth: int = QUEUE_DEPTH, shards: int = 8) -> DataFrame:
    """(shard, place, id, priority) of a stream of events with received_at: the live queue as state, in so many parts by id, each part again whenever something arrives in it.

    What arrives gets its priority then and keeps it; an id that waits already changes nothing; each part holds `depth` events at most, so the first `depth` of all
    parts (queue_head) are those of one queue. The state is bounded, and no task sees more of a batch than a part's share, already cut to its best.
    """
    each = events.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.round(priority(F.col("received_at")), 9).alias("priority"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, values = state.get if state.exists else ([], [])
        held = dict(zip(ids, values, strict=True))
        for f in frames:
            for i, x in zip(f["id"].tolist(), f["priority"].tolist(), strict=True):
                held.setdefault(i, x)
            held = dict(sorted(held.items(), key=lambda r: (-r[1], r[0]))[:depth])
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"shard": key[0], "place": range(1, len(held) + 1), "id": list(held), "priority": list(held.values())})

    return each.groupBy("shard").applyInPandasWithState(step, "shard int, place int, id long, priority double", "ids array<bigint>, priorities array<double>", "update", "NoTimeout")


def queue_head(parts: DataFrame, depth: int = QUEUE_DEPTH) -> DataFrame:
    """The queue from its parts (shard, place, id, priority) as they are now."""
    return parts.orderBy(F.desc("priority"), "id").limit(depth)


def client_window(events: DataFrame, categories: tuple[str, ...], min_reliability: float, end: datetime, span_h: int) -> DataFrame:
    """What a window of time shows; no score counts as 0."""
    last = F.lit(end).cast("timestamp_ntz")
    inside = (F.col("occurred_at") <= last) & (F.col("occurred_at") >= last - F.expr(f"INTERVAL {span_h} HOURS"))
    return events.filter(F.col("category").isin(*categories) & (F.coalesce("reliability", F.lit(0.0)) >= min_reliability) & inside)


def live_filter(events: DataFrame, countries: tuple[str, ...] = (), actor: str | None = None, weapons: tuple[str, ...] = ()) -> DataFrame:
    """A new event against a viewer's filters, on the event itself; weapons is an array of structs there. Works on streams."""
    out = events
    if countries:
        out = out.filter(F.lower("country").isin(*[c.lower() for c in countries]))
    if actor:
        names = [F.lower(F.col(c)).contains(actor.strip().lower()) for c in ("actor_a", "actor_b", "actor_a_canonical", "actor_b_canonical") if c in events.columns]
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(n, F.lit(False))
        out = out.filter(hit)
    if weapons:
        out = out.filter(F.exists("weapons", lambda w: w["weapon_key"].isin(*weapons)))
    return out


def replay_panes(events: DataFrame, step_min: int = STEP_MIN) -> DataFrame:
    """(pane, country, n): events by steps of time from 1970 on, and by country. Works on streams, with a row of state for each step and country, whatever the span of the windows made of it."""
    pane = F.floor(seconds(F.col("occurred_at")) / (step_min * 60)).cast("long")
    return events.filter("occurred_at is not null").groupBy(pane.alias("pane"), "country").agg(F.count("*").alias("n"))


def windows_of(panes: DataFrame, span_h: int, step_min: int = STEP_MIN) -> DataFrame:
    """(window_end, n, countries) of a window that slides by the step, from panes: how many events it covers and, exactly, of how many countries; windows without events have no row.

    A pane enters a window once and leaves it a span later, and so does a country, unless it comes again meanwhile. These changes are summed up by time: there are as many as the calendar has
    steps, so one task adds them up in order, and events aren't copied into the windows that cover them.
    """
    k, rest = divmod(span_h * 60, step_min)
    if rest:
        raise ValueError("a span takes whole steps")
    change = lambda at, n, countries: F.struct(at.cast("long").alias("at"), n.cast("long").alias("n"), countries.cast("long").alias("countries"))
    zero, pane = F.lit(0), F.col("pane")
    counts = panes.groupBy("pane").agg(F.sum("n").alias("n")).select(F.explode(F.array(change(pane + 1, F.col("n"), zero), change(pane + k + 1, -F.col("n"), zero))).alias("c"))
    before = F.lag("pane").over(Window.partitionBy("country").orderBy("pane"))
    seen = panes.filter("country is not null").select("country", "pane").withColumn("before", before)
    begin = F.greatest(pane, F.coalesce(F.col("before") + k, pane))
    seen = seen.select(F.explode(F.array(change(begin + 1, zero, F.lit(1)), change(pane + k + 1, zero, F.lit(-1)))).alias("c"))
    sums = counts.unionAll(seen).select("c.*").groupBy("at").agg(F.sum("n").alias("n"), F.sum("countries").alias("countries"))
    order = Window.orderBy("at")
    runs = sums.select("at", F.sum("n").over(order).alias("n"), F.sum("countries").over(order).alias("countries"), F.lead("at").over(order).alias("next")).filter("n > 0")
    each = runs.select(F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("at"), "n", "countries")
    return each.select(F.timestamp_seconds(F.col("at") * (step_min * 60)).cast("timestamp_ntz").alias("window_end"), "n", "countries")


def replay_windows(events: DataFrame, span_h: int, step_min: int = STEP_MIN) -> DataFrame:
    """(window_end, n, countries) of a window that slides by the step over the events."""
    return windows_of(checkpoint(replay_panes(events, step_min)), span_h, step_min)


def radius_deg(radius_m: Column) -> Column:
    return F.greatest(F.coalesce(radius_m, F.lit(UNKNOWN_RADIUS_M)) / 1000 / KM_PER_DEGREE, F.lit(LEAST_DEG))


def target_altitude(radius_m: Column) -> Column:
    return F.least(F.greatest(0.3 + radius_deg(radius_m) / 18, F.lit(0.32)), F.lit(1.4))


def presentation(events: DataFrame, now: datetime) -> DataFrame:
    """id and what an event is drawn with: radius, ring, fill, core dot, glow, dwell and altitude."""
    r, moment = F.col("geo_radius_m"), F.lit(now).cast("timestamp_ntz")
    age_ms = (seconds(moment) - seconds(F.col("occurred_at"))) * 1000
    extra = F.least(F.coalesce("fatalities", F.lit(0)) * DWELL_MS_EACH, F.lit(MOST_DWELL_MS - BASE_DWELL_MS))
    fill = 0.08 + 0.5 * F.least(F.greatest(F.coalesce("reliability", F.lit(0.25)), F.lit(0.0)), F.lit(1.0))
    return events.select(
        "id",
        F.round(radius_deg(r), 6).alias("radius_deg"),
        F.round(F.greatest(radius_deg(r) * 1.6, F.lit(1.2)), 6).alias("ring_deg"),
        F.round(fill, 6).alias("fill_alpha"),
        (F.coalesce("reliability", F.lit(0.0)) >= 0.5).alias("core_dot"),
        F.round(F.when((age_ms < 0) | (age_ms > 3_600_000), 0.0).otherwise(1 - age_ms / 3_600_000), 6).alias("recency_boost"),
        (BASE_DWELL_MS + extra).cast("long").alias("dwell_ms"),
        F.round(target_altitude(r), 6).alias("target_altitude"),
    )


def visible(events: DataFrame, lat: float, lon: float, altitude: float) -> DataFrame:
    """id, on_screen and presented: inside the camera's cone, and near enough not to move it."""
    angle = angle_deg(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    seen = angle < VISIBLE_DEG + VISIBLE_DEG_BY_ALTITUDE * min(altitude, 2)
    return events.select("id", seen.alias("on_screen"), (seen & (F.lit(altitude) <= target_altitude(F.col("geo_radius_m")) * 1.6)).alias("presented"))


def next_flight(queue: DataFrame, lat: float, lon: float, altitude: float) -> DataFrame:
    """The head of the queue, and whether the camera has to fly to it."""
    head = queue.orderBy(F.desc("priority"), "id").limit(1)
    return head.join(visible(head, lat, lon, altitude).select("id", "presented"), "id").withColumn("fly", ~F.col("presented")).drop("presented")


def strike_arcs(events: DataFrame) -> DataFrame:
    """Ends of the arc of each event with an inferred origin."""
    return events.filter("origin_lat is not null and origin_lon is not null").select("id", F.col("origin_lat").alias("start_lat"), F.col("origin_lon").alias("start_lon"), F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))


def flight_path(arcs: DataFrame, steps: int = 8) -> DataFrame:
    """Points along the great circle of each arc, eased in and out."""
    p = arcs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("u", F.col("step") / steps)
    eased = F.when(F.col("u") < 0.5, 4 * F.pow("u", F.lit(3))).otherwise(1 - F.pow(-2 * F.col("u") + 2, F.lit(3)) / 2)
    lat, lon = great_circle(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"), eased)
    return p.select("id", "step", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def possible(weapons: DataFrame) -> DataFrame:
    """weapons with a label that says whether the hit is only possible."""
    return weapons.withColumn("label", F.when(F.col("confidence") < 0.6, F.concat(F.lit("possible "), "display_name")).otherwise(F.col("display_name")))
