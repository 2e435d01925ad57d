"""Queries by name: each applies an operator to whole tables; ORACLES has the SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import root_domain
from ..operators import cluster, display, enrich, live, merge, normalize, score, serve
from ..schema import EVENT
from ..sources import readers
from ..streaming import dequeue, ingest
from . import fixtures as fx

NOW = datetime(2024, 1, 31)
SINCE, UNTIL = datetime(2024, 1, 5), datetime(2024, 1, 25)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def toy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events with given clusters, and the clusters with heat on every third."""
    e = fx.events(spark, sf_dir).withColumn("cluster_id", F.expr(fx.CLUSTER))
    c = cluster.cluster_stats(e.filter("cluster_id is not null")).withColumn("thermal_corroborated", F.col("cluster_id") % 12 == 0)
    return e, c


def plain(df: DataFrame) -> DataFrame:
    """Arrays as text, for comparison by value, without the raw row."""
    df = df.drop("raw_payload")
    return df.select(*[F.array_join(F.col(c), "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


@query
def cluster_and_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cluster, corroborate, score, list."""
    e = cluster.assign_clusters(fx.events(spark, sf_dir).drop("reliability"), text_rule=False)
    e = cluster.stored(e)
    c = score.mark_thermal(cluster.cluster_stats(e), score.corroborated(e, fx.hotspots(spark, sf_dir)))
    c = cluster.stored(score.score_clusters(e, c))  # a row a cluster, read twice
    return serve.list_events(cluster.write_back(e, c), c, serve.EventQuery(NOW, since=SINCE, limit=10_000))


@query
def cluster_and_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the whole match rule, texts as well."""
    e = cluster.stored(cluster.assign_clusters(fx.events(spark, sf_dir).drop("reliability")))
    c = score.mark_thermal(cluster.cluster_stats(e), score.corroborated(e, fx.hotspots(spark, sf_dir)))
    c = cluster.stored(score.score_clusters(e, c))  # a row a cluster, read twice
    return serve.list_events(cluster.write_back(e, c), c, serve.EventQuery(NOW, since=SINCE, limit=10_000))


@query
def list_events_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without clusters, with the origins that their actors' names give."""
    e = enrich.infer_origin(with_forces(spark, sf_dir)).withColumn("cluster_id", F.lit(None).cast("long"))
    c = cluster.cluster_stats(e.filter("cluster_id is not null")).withColumn("thermal_corroborated", F.lit(False))
    return serve.list_events(e, c, serve.EventQuery(NOW))


@query
def list_events_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.list_events(*toy(spark, sf_dir), serve.EventQuery(NOW))


@query
def list_events_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.list_events(*toy(spark, sf_dir), serve.EventQuery(NOW, since=SINCE, until=UNTIL, bbox="-100,-40,60,30"))


@query
def list_events_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.list_events(*toy(spark, sf_dir), serve.EventQuery(NOW, countries=("nation_3", "NATION_7"), categories=("airstrike", "ied")))


@query
def list_events_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.list_events(*toy(spark, sf_dir), serve.EventQuery(NOW, min_reliability=0.5))


@query
def list_events_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.list_events(*toy(spark, sf_dir), serve.EventQuery(NOW, actor="actor3"))


@query
def list_events_actor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the index of names."""
    e, c = toy(spark, sf_dir)
    return serve.list_events(e, c, serve.EventQuery(NOW, actor="actor3"), names=serve.actor_names(e))


@query
def list_events_weapon(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = toy(spark, sf_dir)
    return serve.list_events(e, c, serve.EventQuery(NOW, weapons=("himars", "grad")), enrich.extract_weapons(e))


@query
def event_detail_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = toy(spark, sf_dir)
    return serve.event_members(e, e.select(F.col("id").alias("event_id")))


@query
def event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = toy(spark, sf_dir)
    c = score.score_clusters(e, c)
    out = serve.event_payload(e, c, enrich.extract_weapons(e))
    keys = F.array_join(F.transform("weapons", lambda w: w["weapon_key"]), "|")
    return plain(out.select("id", "cluster_id", "sources", "source_urls", F.col("source_count").cast("long").alias("source_count"), "reliability", "reliability_explanation", "thermal_corroborated", keys.alias("weapons")))


@query
def facet_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.country_facet(fx.events(spark, sf_dir))


@query
def facet_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.actor_facet(fx.events(spark, sf_dir))


@query
def facet_weapon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.weapon_facet(enrich.extract_weapons(fx.notes(spark, sf_dir)))


@query
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.filter_options(fx.events(spark, sf_dir), enrich.extract_weapons(fx.notes(spark, sf_dir)))


@query
def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of 40 neighbours by id, so that cards have more urls than they show."""
    e = fx.events(spark, sf_dir).withColumn("cluster_id", F.expr("id - id % 40"))
    c = cluster.cluster_stats(e).withColumn("thermal_corroborated", F.lit(False))
    c = score.score_clusters(e, c)
    out = serve.card(serve.event_payload(e, c, enrich.extract_weapons(e)))
    return out.select("id", F.array_join("shown_urls", "|").alias("shown_urls"), "more_urls")


@query
def hotspots_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.list_hotspots(fx.hotspots(spark, sf_dir), NOW, since=SINCE, bbox="-100,-40,60,30")


@query
def baseline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.baseline_totals(toy(spark, sf_dir)[0], fx.MONTH)


@query
def baseline_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the latest month with baseline data."""
    return plain(serve.baseline_report(toy(spark, sf_dir)[0]))


@query
def baseline_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.baseline_by_country(fx.events(spark, sf_dir), fx.MONTH)


@query
def baseline_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.baseline_months(fx.events(spark, sf_dir))


@query
def normalize_acled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(normalize.acled(fx.raw(spark, sf_dir, fx.ACLED_RAW))[0])


@query
def acled_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.acled(fx.raw(spark, sf_dir, fx.ACLED_RAW))[0].select("source_event_id", "raw_payload")


@query
def normalize_acled_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.acled(fx.raw(spark, sf_dir, fx.ACLED_RAW))[1]


@query
def normalize_gdelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(normalize.gdelt(fx.raw(spark, sf_dir, fx.GDELT_RAW))[0])


@query
def gdelt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = normalize.gdelt_payload(fx.raw(spark, sf_dir, fx.GDELT_RAW))
    return p.select("source_event_id", F.element_at("raw_payload", "EventCode").alias("code"), F.size(F.map_keys("raw_payload")).cast("long").alias("n"))


@query
def normalize_ucdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(normalize.ucdp(fx.raw(spark, sf_dir, fx.UCDP_RAW))[0])


@query
def normalize_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.firms(fx.raw(spark, sf_dir, fx.FIRMS_RAW))


@query
def ucdp_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.ucdp_watermark(fx.raw(spark, sf_dir, fx.UCDP_RAW))


@query
def gdelt_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw(spark, sf_dir, fx.GDELT_RAW)
    return raw.select("c0", normalize.gdelt_category(F.trim("c26"), F.trim("c28")).alias("category"))


@query
def default_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    given = F.when(F.col("id") % 2 == 0, F.col("geo_radius_m"))
    return e.select("id", normalize.default_radius(F.col("geo_precision"), given).cast("long").alias("radius"))


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored events, and a batch that revises some of them, adds others and has some twice."""
    e = fx.events(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("admin1", "location_name", "raw_event_type", "raw_payload")})
    stored = e.filter("id % 3 <> 2")
    again = e.filter("id % 3 <> 0")
    first = again.withColumn("batch_pos", F.col("id"))
    second = again.filter("id % 5 = 0").withColumns({"batch_pos": F.col("id") + 10_000_000, "notes": F.lit(None).cast("string")})
    batch = first.unionByName(second).withColumn("fatalities", F.coalesce(F.col("fatalities"), F.lit(0)) + 1)
    return stored, batch.select(*[f.name for f in EVENT.fields], "batch_pos")


@query
def upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*batches(spark, sf_dir)).select("source", "source_event_id", "id", "fatalities", "notes", "reliability")


@query
def upsert_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.inserted(*batches(spark, sf_dir)).select("source", "source_event_id")


@query
def insert_ignore_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hotspots(spark, sf_dir)
    batch = h.withColumn("batch_pos", F.col("id")).unionByName(h.withColumns({"batch_pos": -F.col("id"), "frp": F.lit(0.0)}))
    return merge.insert_hotspots(h.filter("id % 4 = 0"), batch).select("satellite", "acquired_at", "lat", "lon", "frp")


@query
def watermark_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.update_marks(fx.small(spark, sf_dir, fx.MARKS), fx.small(spark, sf_dir, fx.RUNS))


@query
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.feed_health(fx.small(spark, sf_dir, fx.MARKS), fx.small(spark, sf_dir, fx.CREDENTIALS))


@query
def credentials_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.credentials_due(fx.small(spark, sf_dir, fx.CREDENTIALS), NOW)


@query
def weapon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.extract_weapons(fx.notes(spark, sf_dir)).select("event_id", "weapon_key", "display_name", "category", "confidence", "method")


@query
def weapon_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.extract_weapons(fx.notes(spark, sf_dir)).select("event_id", "weapon_key", "evidence_span")


@query
def actor_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.actor_vocabulary(fx.events(spark, sf_dir))


NAMES = "CASE id % 8 WHEN 0 THEN ' Kremlin' WHEN 1 THEN 'IDF' WHEN 2 THEN 'Hamas' WHEN 3 THEN 'al shabaab' WHEN 4 THEN CONCAT('Actor', CAST(id % 6 AS STRING)) WHEN 5 THEN 'RSF ' WHEN 6 THEN 'nobody' END"


@query
def actor_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.events(spark, sf_dir).select(F.expr(NAMES).alias("name"))
    return enrich.canonical_actors(names, spark.createDataFrame([], "name string"))


@query
def actor_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    names = e.select(F.concat(F.lit("Group of "), F.col("actor_a")).alias("name")).unionAll(e.select("actor_a"))
    return enrich.canonical_actors(names, enrich.actor_vocabulary(e))


@query
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).withColumn("actor_a", F.expr(NAMES))
    return enrich.canonicalize(e).select("id", "actor_a", "actor_a_canonical", "actor_b_canonical")


FORCES = "CASE id % 5 WHEN 0 THEN 'Military Forces of Russia (2000-)' WHEN 1 THEN 'Police Forces of the Sudan (2019-) Air Branch' WHEN 2 THEN 'military forces of South Sudan (2011-)' WHEN 3 THEN 'Rebels of Mali' END"
WHERE = "CASE id % 3 WHEN 0 THEN ' russia ' WHEN 1 THEN 'Ukraine' ELSE country END"


def with_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.events(spark, sf_dir).withColumns({"actor_a": F.expr(FORCES), "country": F.expr(WHERE)})


@query
def origin_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.infer_origin(with_forces(spark, sf_dir)).select("id", "origin_country", "origin_lat", "origin_lon", "origin_precision", "origin_method", "origin_confidence")


@query
def strike_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.strike_arcs(enrich.infer_origin(with_forces(spark, sf_dir)))


@query
def great_circle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.flight_path(live.strike_arcs(enrich.infer_origin(with_forces(spark, sf_dir))))


@query
def category_compat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the categories that reports have go together."""
    c = fx.events(spark, sf_dir).select(F.col("category").alias("a")).distinct()
    return c.join(c.withColumnRenamed("a", "b"), cluster.compatible(F.col("a"), F.col("b")))


@query
def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.candidates(fx.events(spark, sf_dir)).select("id", "cand_id", "distance_m", F.col("rn").cast("long").alias("rn"))


@query
def cluster_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.parents(fx.events(spark, sf_dir), text_rule=False)


@query
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign_clusters(fx.events(spark, sf_dir), text_rule=False).select("id", "cluster_id")


@query
def cluster_assign_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign_clusters(fx.events(spark, sf_dir), text_rule=True).select("id", "cluster_id")


@query
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cluster.cluster_stats(toy(spark, sf_dir)[0].filter("cluster_id is not null"))
    return c.withColumns({"centroid_lat": F.round("centroid_lat", 9), "centroid_lon": F.round("centroid_lon", 9)})


@query
def thermal_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = toy(spark, sf_dir)
    return score.mark_thermal(c, score.corroborated(e.filter("cluster_id is not null"), fx.hotspots(spark, sf_dir))).select("cluster_id", "thermal_corroborated")


@query
def root_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", root_domain(F.col("url")).alias("domain"))


@query
def reliability_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.evidence(toy(spark, sf_dir)[0].filter("cluster_id is not null"))
    return out.select("cluster_id", F.col("n_domains").cast("long").alias("n_domains"), F.col("n_fatalities").cast("long").alias("n_fatalities"), F.col("members").cast("long").alias("members"), "consistent")


@query
def reliability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = toy(spark, sf_dir)
    return score.score_clusters(e.filter("cluster_id is not null"), c).select("cluster_id", "reliability")


@query
def reliability_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = toy(spark, sf_dir)
    return score.score_clusters(e.filter("cluster_id is not null"), c).select("cluster_id", "explanation")


@query
def live_priority_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_queue(fx.events(spark, sf_dir), NOW).select("id", F.round("priority", 6).alias("priority"))


@query
def live_next_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.next_flight(live.live_queue(fx.events(spark, sf_dir), NOW), 10.0, 20.0, 0.5).select("id", "fly")


@query
def client_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.client_window(fx.events(spark, sf_dir), ("airstrike", "ied", "protest"), 0.3, UNTIL, 168).select("id")


@query
def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    w = enrich.extract_weapons(e).groupBy(F.col("event_id").alias("id")).agg(F.collect_list(F.struct("weapon_key")).alias("weapons"))
    return live.live_filter(e.join(w, "id", "left"), countries=("nation_1", "nation_2", "nation_4"), actor="ACTOR", weapons=("himars", "iskander_m")).select("id")


@query
def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.replay_windows(fx.events(spark, sf_dir), 6).select("window_end", "n")


@query
def replay_windows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span that the display offers, from the same panes."""
    panes = cluster.checkpoint(live.replay_panes(fx.events(spark, sf_dir)))
    each = [live.windows_of(panes, h).withColumn("span_h", F.lit(h).cast("long")) for h in live.SPANS_H]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).unionByName(each[4])


@query
def viewport_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.visible(fx.events(spark, sf_dir), 10.0, 20.0, 0.5)


@query
def presentation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.presentation(fx.events(spark, sf_dir), NOW)


@query
def great_circle_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    return e.select("id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 3).alias("distance_m"))


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export lines as a stream of files in two batches, in the order of their ids: the stored reports, each with the report that its cluster began with."""
    found = ingest.replay(fx.raw(spark, sf_dir, fx.GDELT_RAW), parts=2)
    first = found.select(F.col("id").alias("cluster_id"), F.col("source_event_id").alias("cluster_of"))
    return found.join(first, "cluster_id").select("source", "source_event_id", "category", "lat", "lon", "cluster_of")


@query
def stream_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspots first, then the export lines in two batches: what the list of reports says of each cluster, named by the report that it began with."""
    store = ingest.replay_store(fx.raw(spark, sf_dir, fx.GDELT_RAW), fx.raw(spark, sf_dir, fx.FIRMS_RAW))
    found = store.events()
    first = found.select(F.col("id").alias("cluster_id"), F.col("source_event_id").alias("cluster_of"))
    listed = serve.list_events(found, store.clusters(), serve.EventQuery(NOW, since=SINCE, limit=10_000))
    return listed.join(first, "cluster_id").select("cluster_of", "occurred_at", "source_count", "thermal_corroborated", "reliability")


@query
def display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("occurred_at")
    return fx.events(spark, sf_dir).select("id", display.time_ago(at, NOW).alias("ago"), display.utc(at).alias("utc"))


@query
def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", display.outlet(F.col("url")).alias("outlet"))


@query
def feed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.feed_label(serve.feed_health(fx.small(spark, sf_dir, fx.MARKS), fx.small(spark, sf_dir, fx.CREDENTIALS)), NOW)


@query
def weapon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every third text as if they were less sure."""
    found = enrich.extract_weapons(fx.notes(spark, sf_dir))
    return live.possible(found.withColumn("confidence", F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(F.col("confidence")))).select("event_id", "weapon_key", "label")


@query
def stream_dequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewer for each category, whose queue takes all its events as a stream and gives away ten when asked."""
    path = f"{cluster.shared_folder(spark).rstrip('/')}/dequeue-{uuid.uuid4().hex}"
    now = F.lit(NOW).cast("timestamp_ntz")
    came = fx.events(spark, sf_dir).select(F.col("category").alias("viewer"), now.alias("received_at"), "id", "occurred_at", "category", "fatalities", "reliability", "lat", "lon", "geo_radius_m")
    came.write.parquet(f"{path}/events")
    asks = came.select("viewer").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10))))
    asks.select("viewer", (now + F.make_dt_interval(mins=F.col("k"))).alias("at"), F.lit("take").alias("kind"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"), F.lit(0.5).alias("altitude")).write.parquet(f"{path}/asks")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{path}/{name}").schema).parquet(f"{path}/{name}")
    with dequeue.rocksdb(spark):
        given = dequeue.dequeue(read("events"), read("asks")).writeStream.option("checkpointLocation", f"{path}/at").format("parquet").option("path", f"{path}/given")
        given.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("viewer string, at timestamp_ntz, id long, priority double, fly boolean").parquet(f"{path}/given")
