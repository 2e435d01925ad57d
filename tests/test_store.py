"""The streams' stored state: what a batch reads, in which order feeds come, what is written anew."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberloom.operators import serve
from emberloom.schema import EVENT
from emberloom.streaming import ingest
from emberloom.streaming.store import days_of, spans_of
from tests.test_sources_and_streaming import rows_of

HOT = "satellite string, acquired_at timestamp_ntz, lat double, lon double, brightness double, frp double, confidence string"
DAY = datetime(2024, 3, 5)


def reports(spark, rows):
    """rows: (key, day, lat, lon, category)."""
    made = []
    for key, day, lat, lon, category in rows:
        r = dict.fromkeys([f.name for f in EVENT.fields])
        r |= {"source": "acled", "source_event_id": key, "occurred_at": DAY + timedelta(days=day), "lat": lat, "lon": lon, "geo_precision": "settlement", "geo_radius_m": 5000, "category": category, "actor_a": "Rebels", "source_urls": [f"https://n{key}.com/a"]}
        made.append(r)
    return spark.createDataFrame(made, EVENT)


def spots(spark, rows):
    return spark.createDataFrame([("N", DAY + timedelta(days=d, hours=12), lat, lon, 300.0, 1.0, "n") for d, lat, lon in rows], HOT)


def told(store):
    names = {r.id: r.source_event_id for r in store.events().collect()}
    clusters = {names[r.cluster_id]: (r.member_count, r.thermal_corroborated, r.reliability, names[r.representative]) for r in store.clusters().collect()}
    listed = serve.list_events(store.events(), store.clusters(), serve.EventQuery(DAY, since=DAY - timedelta(days=30), limit=1000)).collect()
    own = {r.source_event_id: (r.reliability, r.source_count) for r in store.events().collect()}
    for r in listed:  # what a cluster says stands on the report that speaks for it
        c = clusters[names[r.cluster_id]]
        assert (r.source_count, r.thermal_corroborated, r.reliability, names[r.id]) == c and own[names[r.id]] == (c[2], c[0])
    assert len(listed) == len(clusters)
    return clusters


EVENTS = [("A1", 0, 10.0, 20.0, "airstrike"), ("A2", 0, 10.0, 20.01, "airstrike"), ("B1", 1, 30.0, 40.0, "artillery"), ("C1", 2, -5.0, 8.0, "protest"), ("D1", 9, 10.0, 20.0, "ied")]
HEAT = [(0, 10.01, 20.0), (1, 30.01, 40.0), (2, -5.0, 8.0), (9, 55.0, 20.0)]
WANT = {"A1": (2, True), "B1": (1, True), "C1": (1, False), "D1": (1, False)}


@pytest.mark.parametrize("seed", [1, 4])
def test_feeds_may_come_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [EVENTS[:1], EVENTS[1:3], EVENTS[3:]]  # reports keep their order, as it says who follows whom
    heat = HEAT[:]
    rng.shuffle(heat)
    turns = [("e", e) for e in events]
    for h in (heat[:2], heat[2:]):
        turns.insert(rng.randint(0, len(turns)) if seed > 1 else 0, ("h", h))  # seed 1: all hotspots first
    store, at = ingest.Store(spark, str(tmp_path / "s")), {"e": 0, "h": 0}
    for kind, rows in turns:
        if kind == "e":
            ingest.merge_batch(store, reports(spark, rows), at["e"], feed="acled")
        else:
            ingest.merge_hotspots(store, spots(spark, rows), at["h"])
        at[kind] += 1
    got = told(store)
    assert {k: v[:2] for k, v in got.items()} == WANT and got["A1"][2] == 0.95 and got["C1"][2] is None
    assert store.rows("runs").count() == len(turns) and store.rows("runs").agg(F.count_distinct("version")).first()[0] == len(turns)


def read_since(spark, last):
    """Rows that scans have read in stages after `last`, and the last stage now."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    found = [(stages.apply(k).stageId(), stages.apply(k).inputRecords()) for k in range(stages.size())]
    return sum(n for i, n in found if i > last), max((i for i, _ in found), default=-1)


def test_a_batch_reads_its_days_and_not_the_history(spark, tmp_path):
    store, read, last = ingest.Store(spark, str(tmp_path / "s")), [], read_since(spark, -1)[1]
    for k in range(4):
        day = [(f"{k}-{i}", 4 * k, 10.0 + i, 20.0, "airstrike") for i in range(30)]
        ingest.merge_hotspots(store, spots(spark, [(4 * k, 10.0, 20.0)]), k)
        ingest.merge_batch(store, reports(spark, day), k, feed="acled")
        n, last = read_since(spark, last)
        read.append(n)
    assert store.events().count() == 120
    # keys are read by bucket, 30 more of them with each batch; nothing else grows
    keys = [30 * k for k in range(4)]
    rest = [n - 8 * m for n, m in zip(read, keys, strict=True)]
    assert max(rest[2:]) <= rest[1] + 60 and read[3] < 2 * read[1] + 8 * keys[3]
    assert max(read[1:]) - min(read[1:]) < 600


class Seen(Exception):
    pass


def test_clustering_gets_reports_that_are_worked_out(spark, tmp_path, monkeypatch):
    """Clustering looks at both tables from many sides, so a plan behind them would be in its own many times, and the driver holds that."""
    store = ingest.Store(spark, str(tmp_path / "s"))
    ingest.merge_batch(store, reports(spark, EVENTS[:1]), 0, feed="acled")

    def look(near, new, *rest):
        plans = [df._jdf.queryExecution().analyzed().toString() for df in (near, new)]
        raise Seen([len(p.splitlines()) for p in plans])

    monkeypatch.setattr(ingest.cluster, "assign_batch", look)
    with pytest.raises(Seen) as seen:
        ingest.merge_batch(store, reports(spark, EVENTS[1:3]), 1, feed="acled")
    assert max(seen.value.args[0]) <= 3, seen.value


def test_a_revision_that_moves_a_report_and_compaction(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "s"))
    ingest.merge_batch(store, reports(spark, EVENTS[:2]), 0, feed="acled")
    ingest.merge_batch(store, reports(spark, [("A2", 3, 50.0, 20.0, "riot")]), 1, feed="acled")
    moved = {r.source_event_id: r for r in store.events().collect()}
    assert moved["A2"].lat == 50.0 and str(moved["A2"].day) == "2024-03-08" and moved["A2"].cluster_id == moved["A1"].id
    assert [r.source_event_id for r in store.events(["2024-03-05"]).collect()] == ["A1"] and store.events(["2024-03-06"]) is None
    ingest.merge_batch(store, reports(spark, [("A2", 3, 51.0, 20.0, "riot"), ("E1", 3, 51.0, 20.0, "riot")]), 2, feed="acled")
    before = told(store), store.events().count(), store.weapons().count() if store.weapons() is not None else 0
    assert store.compact("events", 1) + store.compact("clusters", 1) + store.compact("keys", 0) >= 2 and store.compact("events", 1) == 0
    assert (told(store), store.events().count(), store.weapons().count() if store.weapons() is not None else 0) == before
    ingest.merge_batch(store, reports(spark, [("A1", 0, 10.0, 20.0, "ied")]), 3, feed="acled")
    got = {r.source_event_id: r for r in store.events().collect()}
    assert got["A1"].category == "ied" and got["A2"].lat == 51.0 and len(got) == 3


def test_a_run_that_broke_off_leaves_nothing(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "s"))
    ingest.merge_batch(store, rows_of(spark, [1])[0], 0)
    version = store.begin("gdelt", 1)
    store.write("keys", store.rows("keys").select("source", F.lit("2").alias("source_event_id"), "day", "bucket"), "gdelt", 1, version)
    ingest.merge_batch(store, rows_of(spark, [2])[0], 1)
    assert sorted(r.source_event_id for r in store.events().collect()) == ["1", "2"]
    assert ingest.Store(spark, store.path).begin("gdelt", 2) == version + 2


def test_a_batch_is_few_jobs_over_small_plans(spark, tmp_path):
    """Each stage and each broadcast takes a buffer of megabytes in the driver, whatever it brings, so a batch that meets stored reports and hotspots has no more of them than it needs."""
    store = ingest.Store(spark, str(tmp_path / "s"))
    ingest.merge_hotspots(store, spots(spark, HEAT), 0)
    ingest.merge_batch(store, rows_of(spark, [1, 2, 3])[0], 0)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("batch", "batch")
    try:
        ingest.merge_batch(store, rows_of(spark, [3, 4, 5])[0], 1)
        jobs = tracker.getJobIdsForGroup("batch")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert len(store.events().collect()) == 5 and len(jobs) <= 128, len(jobs)


def test_days_of_several_spans_are_those_of_each(spark):
    times = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-05 01:00:00' AS t UNION ALL SELECT TIMESTAMP_NTZ '2024-03-09 20:00:00' UNION ALL SELECT NULL")
    spans = [(6 * 3600, 6 * 3600), (6 * 3600, 30 * 3600), (0, 0)]
    assert spans_of(times, *spans) == [days_of(times, *s) for s in spans] and spans_of(times.limit(0), *spans) == [[], [], []]
