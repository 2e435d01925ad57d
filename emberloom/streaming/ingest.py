"""Micro-batches: normalize, merge, enrich, cluster and score what is new, and publish it. A batch reads and writes the days that it touches; the checkpoint's offsets are the mark."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cluster, enrich, merge, normalize, score, serve
from ..schema import EVENT, EVENT_KEY, HOTSPOT_KEY
from ..sources import readers
from .store import BY, MOST_FOLDERS, Store, bucket_of, day_of, days_of, spans_of

#: How often feeds are read, in seconds.
CADENCE_S = {"acled": 21_600, "gdelt": 900, "firms": 10_800, "ucdp": 604_800}
HOUR = 3600
log = logging.getLogger(__name__)
Publish = Callable[[DataFrame, int], None]


def ids_of(events: DataFrame) -> DataFrame:
    """events with an id from their key: the same in every run, without a counter."""
    return events.withColumn("id", F.xxhash64(*EVENT_KEY))


#: Where a row was read, if it was in a file.
READ_AT = ("_file", "_block")


def told_place(rows: DataFrame) -> DataFrame:
    """rows of a stream's batch, narrowly derived, with the file and block that each was read from."""
    return rows.withColumns({"_file": F.input_file_name(), "_block": F.input_file_block_start()})


def in_order(rows: DataFrame) -> DataFrame:
    """rows whose batch_pos, which counts on from task to task, follows the names of files, their blocks and lines where there are several files: tasks take these by size."""
    if "_file" not in rows.columns:
        return rows
    blocks = sorted(tuple(r) for r in rows.select(*READ_AT).distinct().collect())  # as many as the files' blocks, so the driver may hold them
    if len({f for f, _ in blocks}) > 1:
        place = F.create_map(*[x for k, (f, b) in enumerate(blocks) for x in (F.xxhash64(F.lit(f), F.lit(b).cast("long")), F.lit(k << 33))])
        rows = rows.withColumn("batch_pos", F.element_at(place, F.xxhash64(*READ_AT)) + F.col("batch_pos").bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.drop(*READ_AT)


def heat_of(store: Store, events: DataFrame, days: list[str]) -> DataFrame | None:
    """cluster_id of the given reports that a hotspot stored on one of these days corroborates."""
    hot = store.hotspots(days)
    return None if hot is None else cluster.checkpoint(score.corroborated(events, hot))


def clusters_after(store: Store, changed: DataFrame, touched: DataFrame, heat: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): the clusters of touched (cluster_id, cluster_day), scored over all their members as they are with changed rows in place, and those members; changed ones have _changed.

    A cluster says when it was first and last seen, so its members are read from those days. heat (cluster_id), of clusters in touched, marks some; marks stay.
    """
    before = store.clusters(sorted(str(r[0]) for r in touched.select("cluster_day").distinct().collect())) if store.begun("clusters") else None
    members = changed.join(touched.select("cluster_id"), "cluster_id", "left_semi").withColumn("_changed", F.lit(True))
    # what is known of a cluster besides its members is put together by one shuffle: the day, and the marks
    marked = lambda df, mark: df.select("cluster_id", F.lit(None).cast("date").alias("cluster_day"), mark.alias("thermal_corroborated"))
    known = touched.select("cluster_id", "cluster_day", F.lit(False).alias("thermal_corroborated"))
    if before is not None:
        before = before.join(touched.select("cluster_id"), "cluster_id", "left_semi")
        known = known.unionByName(marked(before, F.col("thermal_corroborated")))
        spans = before.select(F.explode(F.sequence(day_of(F.col("first_seen")), day_of(F.col("last_seen")))).alias("d")).distinct()
        stored = store.events(sorted(str(r[0]) for r in spans.collect()))
        if stored is not None:
            rest = stored.join(touched.select("cluster_id"), "cluster_id", "left_semi").join(changed.select(*EVENT_KEY), list(EVENT_KEY), "left_anti")
            members = rest.withColumn("_changed", F.lit(False)).unionByName(members, allowMissingColumns=True)
    members = cluster.checkpoint(members)
    known = known if heat is None else known.unionByName(marked(heat, F.lit(True)))
    known = known.groupBy("cluster_id").agg(F.min("cluster_day").alias("cluster_day"), F.max("thermal_corroborated").alias("thermal_corroborated"))
    out = cluster.cluster_stats(members).join(known, "cluster_id")
    return cluster.checkpoint(score.score_clusters(members, out).withColumnRenamed("cluster_day", "day")), members


def merge_batch(
    store: Store, normalized: DataFrame, batch: int, publish: Publish | None = None, text_rule: bool = True, feed: str = "gdelt", rejects: DataFrame | None = None, fetched: Callable[[], int | None] | None = None
) -> None:
    """One batch: revisions change stored reports only; new reports are enriched with weapons, canonical actors and origins, and clustered after all that is stored. Then the clusters of both are scored anew, with
    heat where a stored hotspot is near one of these reports, and each cluster's score and count are written on the report that speaks for it.

    What is read of the store: the keys' buckets, the days of revised reports, the days around the batch's, the days of its clusters, and the hotspots of its days. At the end the full payload of each new
    report is published. A sink that fails is logged and changes nothing: the reports are stored. Rejects are kept with their reasons, and a row of the run's counts says what was fetched, normalized and new.
    """
    with store.lock:
        version = store.begin(feed, batch)
        positioned = in_order(cluster.checkpoint(normalized.withColumns({"batch_pos": F.monotonically_increasing_id(), "bucket": bucket_of(store.buckets)})))
        known = store.latest("keys", [r[0] for r in positioned.select("bucket").distinct().collect()]) if store.begun("keys") else None
        positioned = positioned.drop("bucket")
        near_days, hot_days = [], []
        if store.begun("events") or store.begun("hotspots"):
            near_days, hot_days = spans_of(positioned.select(F.col("occurred_at").alias("t")), (cluster.WINDOW_S, cluster.WINDOW_S), (6 * HOUR, 30 * HOUR))
        again = None
        if known is not None:
            again = cluster.checkpoint(known.join(positioned.select(*EVENT_KEY), list(EVENT_KEY), "left_semi").select(*EVENT_KEY, F.col("day").alias("old_day")))
        new = ids_of(merge.inserted(again if again is not None else positioned.limit(0), positioned))
        # what the next step looks at from many sides is worked out once: plans over it stay small, and so does the driver that makes them
        new = cluster.checkpoint(new.withColumn("arrival", F.struct(F.lit(version).cast("long").alias("batch"), F.col("batch_pos").alias("place"))).drop("batch_pos"))
        names, own = store.vocabulary(), enrich.actor_vocabulary(new)
        new = cluster.checkpoint(enrich.infer_origin(enrich.canonicalize(new, vocabulary=own if names is None else names.unionByName(own))))
        near = store.events(near_days)
        if near is not None:
            near = cluster.checkpoint(near.select("cluster_id", "cluster_day", *[c for c in new.columns if c in near.columns]))
        # a cluster stays with the day of the report that it began with
        own_day = new.select(F.col("id").alias("cluster_id"), day_of(F.col("occurred_at")).alias("cluster_day"))
        began = own_day if near is None else near.select("cluster_id", "cluster_day").union(own_day)
        new = cluster.assign_clusters(new, text_rule) if near is None else cluster.assign_batch(near, new, text_rule)
        new = new.join(began.groupBy("cluster_id").agg(F.min("cluster_day").alias("cluster_day")), "cluster_id", "left")
        new = cluster.checkpoint(new.withColumns({"day": day_of(F.col("occurred_at")), "gone": F.lit(False), "reliability": F.lit(None).cast("double"), "source_count": F.lit(None).cast("long")}))
        changed, moved = new, None
        if again is not None:
            days = sorted(str(r[0]) for r in again.select("old_day").distinct().collect())
            stored = store.events(days) if days else None
            if stored is not None:
                old = stored.join(again.select(*EVENT_KEY), list(EVENT_KEY), "left_semi")
                revised = merge.upsert(old, positioned.join(old.select(*EVENT_KEY), list(EVENT_KEY), "left_semi")).withColumns({"day": day_of(F.col("occurred_at")), "gone": F.lit(False)})
                revised = cluster.checkpoint(revised.join(again, list(EVENT_KEY)))
                moved = revised.filter("day <> old_day")
                changed = cluster.checkpoint(new.unionByName(revised.drop("old_day"), allowMissingColumns=True))
        touched = cluster.checkpoint(changed.groupBy("cluster_id").agg(F.min("cluster_day").alias("cluster_day")))
        clusters, members = clusters_after(store, changed, touched, heat_of(store, changed, hot_days))
        told = cluster.checkpoint(told_anew(members, clusters))
        rows, told = told.filter("_changed or _told").drop("_changed", "_told"), told.drop("_changed", "_told")
        if moved is not None:
            rows = rows.unionByName(moved.withColumns({"day": F.col("old_day"), "gone": F.lit(True)}).drop("old_day"), allowMissingColumns=True)
        weapons = enrich.extract_weapons(new).join(new.select(F.col("id").alias("event_id"), "day"), "event_id")
        weapons = cluster.checkpoint(weapons) if publish else weapons
        store.write("weapons", weapons, feed, batch, version)
        store.write("events", rows.withColumn("gone", F.coalesce("gone", F.lit(False))), feed, batch, version)
        keys = new if moved is None else new.select(*EVENT_KEY, "day").unionByName(moved.select(*EVENT_KEY, "day"))
        store.write("keys", keys.select(*EVENT_KEY, "day", bucket_of(store.buckets).alias("bucket")), feed, batch, version)
        store.write("clusters", clusters, feed, batch, version)
        store.write("names", own if names is None else own.join(names, "name", "left_anti"), feed, batch, version)
        if rejects is not None:
            store.write("rejects", rejects, feed, batch, version)
        write_run(store, feed, batch, version, fetched, positioned, new)
    if publish:
        payload = serve.event_payload(told, clusters.drop("day"), weapons.drop("day"), new.select(F.col("id").alias("event_id")))
        payload = payload.drop("day", "gone", "cluster_day", "arrival")
        deliver(publish, payload.select("id", F.to_json(F.struct("*")).alias("value")), batch)


def told_anew(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """members with what their clusters say written back, and _told where a score or count is another now."""
    told = cluster.write_back(members.withColumns({"_r": F.col("reliability"), "_n": F.col("source_count")}), clusters)
    return told.withColumn("_told", ~(F.col("reliability").eqNullSafe(F.col("_r")) & F.col("source_count").eqNullSafe(F.col("_n")))).drop("_r", "_n")


def write_run(store: Store, feed: str, batch: int, version: int, fetched: Callable[[], int | None] | None, normalized: DataFrame, new: DataFrame) -> None:
    """A run's counts (normalized, new_records) in one aggregation, what was fetched beside them, as observed in the pass that normalized it."""
    n = fetched() if fetched else None
    counts = normalized.select(F.lit(False).alias("new")).unionAll(new.select(F.lit(True).alias("new"))).agg(F.count_if(~F.col("new")).alias("normalized"), F.count_if("new").alias("new_records"))
    out = counts.select(F.lit(feed).alias("source"), F.lit(n).cast("long").alias("fetched"), "normalized", (F.lit(n).cast("long") - F.col("normalized")).alias("dropped"), "new_records")
    store.write("runs", out.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")}), feed, batch, version)


def deliver(publish: Publish, payloads: DataFrame, batch: int) -> None:
    try:
        publish(payloads, batch)
    except Exception:  # noqa: BLE001 what a sink raises is its own; the batch is stored
        log.exception("batch %d is stored but was not published", batch)


def merge_hotspots(store: Store, hotspots: DataFrame, batch: int, feed: str = "firms", fetched: Callable[[], int | None] | None = None) -> None:
    """One batch of hotspots: those that aren't stored yet are, and clusters with a kinetic report near one of them are marked and scored anew. Marks are never taken back.

    Reports that come after their hotspots meet them in merge_batch, so it doesn't matter which of the two is first.
    """
    with store.lock:
        version = store.begin(feed, batch)
        positioned = in_order(cluster.checkpoint(hotspots.withColumn("batch_pos", F.monotonically_increasing_id())))
        at = positioned.select(F.col("acquired_at").alias("t"))
        stored = store.hotspots(days_of(at)) if store.begun("hotspots") else None
        new = merge.insert_hotspots(stored if stored is not None else positioned.limit(0), positioned).drop("batch_pos")
        new = cluster.checkpoint(new.withColumns({"day": day_of(F.col("acquired_at")), "id": F.xxhash64(*HOTSPOT_KEY)}))
        store.write("hotspots", new, feed, batch, version)
        events = store.events(days_of(new.select(F.col("acquired_at").alias("t")), 30 * HOUR, 6 * HOUR)) if store.begun("events") else None
        if events is not None:
            heat = score.corroborated(events, new)
            days = events.groupBy("cluster_id").agg(F.min("cluster_day").alias("cluster_day"))
            heat = cluster.checkpoint(heat.join(days, "cluster_id"))
            clusters, members = clusters_after(store, events.limit(0), heat, heat)
            store.write("clusters", clusters, feed, batch, version)
            rows = told_anew(members, clusters).filter("_told").drop("_changed", "_told")
            store.write("events", rows.withColumn("gone", F.lit(False)), feed, batch, version)
        write_run(store, feed, batch, version, fetched, positioned, new)


def observed(raw: DataFrame) -> tuple[DataFrame, Callable[[], int | None]]:
    """raw, and its number of rows as the first pass over it counts them."""
    seen = Observation()
    return raw.observe(seen, F.count(F.lit(1)).alias("n")), lambda: seen.get["n"]


def tidy(store: Store, batch: int, every: int = MOST_FOLDERS) -> None:
    """After so many batches of a feed, days with many small folders become one each."""
    if batch % every == every - 1:
        for table in BY:
            store.compact(table, every)


def trigger(writer, every: str | None):  # noqa: ANN001, ANN201
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def stream_events(
    raw: DataFrame, normalizer: Callable[[DataFrame], tuple[DataFrame, DataFrame]], store: Store, checkpoint: str, publish: Publish | None = None, every: str | None = None, text_rule: bool = True, feed: str = "gdelt"
) -> StreamingQuery:
    """A feed's stream of raw rows into the store; without `every`, what is there now and no more (`cadence` gives a feed's own). Late revisions merge like any other: no event-time mark drops them."""

    def one(df: DataFrame, n: int) -> None:
        counted, fetched = observed(df)
        merge_batch(store, told_place(normalizer(counted)[0]), n, publish, text_rule, feed, normalizer(df)[1], fetched)
        tidy(store, n)

    return trigger(raw.writeStream.queryName(f"{feed} into {store.path}").option("checkpointLocation", checkpoint).foreachBatch(one), every).start()


def stream_hotspots(raw: DataFrame, store: Store, checkpoint: str, every: str | None = None, feed: str = "firms") -> StreamingQuery:
    """A stream of raw hotspot rows into the store, each batch followed by the corroboration that it allows."""

    def one(df: DataFrame, n: int) -> None:
        counted, fetched = observed(df)
        merge_hotspots(store, told_place(normalize.firms(counted)), n, feed, fetched)
        tidy(store, n)

    return trigger(raw.writeStream.queryName(f"{feed} into {store.path}").option("checkpointLocation", checkpoint).foreachBatch(one), every).start()


def cadence(feed: str) -> str:
    """How often a feed is read, as `every` of a stream takes it."""
    return f"{CADENCE_S[feed]} seconds"


def feed_marks(store: Store, marks: DataFrame, at: str, watermarks: DataFrame | None = None) -> DataFrame:
    """marks after the runs in the store, in their order: what each good run brought that was new is added to its feed's records, failures since the last good one are counted, and the last message is kept.

    watermarks (source, watermark) are optional.
    """
    runs = store.rows("runs")
    if runs is None:
        return marks
    good = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("version"))).alias("last_ok"))
    each = runs.join(good, "source").groupBy("source").agg(
        F.max("last_ok").isNotNull().alias("some"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("new_records"))), F.lit(0)).alias("new_records"),
        F.count_if(~F.col("ok") & (F.col("version") > F.coalesce("last_ok", F.lit(-1)))).alias("failures"),
        F.max_by("error", F.when(~F.col("ok"), F.col("version"))).alias("error"),
    )
    each = each.join(watermarks, "source", "left") if watermarks is not None else each.withColumn("watermark", F.lit(None).cast("timestamp_ntz"))
    when = F.lit(at).cast("timestamp_ntz").alias("at")
    nothing = F.lit(None).cast("string").alias("error")
    done = merge.update_marks(marks, each.filter("some").select("source", F.lit(True).alias("ok"), when, "watermark", "new_records", nothing))
    return merge.update_marks(done, each.filter("failures > 0").select("source", F.lit(False).alias("ok"), when, F.lit(None).cast("timestamp_ntz").alias("watermark"), F.lit(0).cast("long").alias("new_records"), "error", "failures"))


def replay_store(raw: DataFrame, hotspots: DataFrame | None = None, parts: int = 2, path: str | None = None, text_rule: bool = True) -> Store:
    """The store after raw hotspot rows, if any, and then raw export rows, landed as files, were streamed, the latter in so many batches. A batch lands as as many files as raw has partitions, each written by a task."""
    spark = raw.sparkSession
    path = path or f"{cluster.shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    store = Store(spark, f"{path}/store")
    if hotspots is not None:
        hotspots.select(*readers.FIRMS_COLUMNS).write.option("header", True).csv(f"{path}/hot")
        stream_hotspots(readers.stream_firms(spark, f"{path}/hot"), store, f"{path}/hot-offsets").awaitTermination()
    at = F.col("c0").try_cast("long")
    cuts = raw.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000).alias("cuts")).first()["cuts"] or [] if parts > 1 else []
    files = raw.rdd.getNumPartitions()
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):  # one batch after another, each in the order of its ids
        part = raw.filter((at > a if a is not None else F.lit(True)) & (at <= b if b is not None else F.lit(True)))
        part = part.repartitionByRange(files, at) if files > 1 else part
        part.sortWithinPartitions(at).write.mode("append").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(f"{path}/landed")
        stream_events(readers.stream_gdelt(spark, f"{path}/landed"), normalize.gdelt, store, f"{path}/offsets", text_rule=text_rule).awaitTermination()
    return store


def replay(raw: DataFrame, parts: int = 2, path: str | None = None, text_rule: bool = True) -> DataFrame:
    """raw export rows landed as files and streamed in so many batches; gives the stored events."""
    found = replay_store(raw, None, parts, path, text_rule).events()
    return found if found is not None else raw.sparkSession.createDataFrame([], EVENT)
