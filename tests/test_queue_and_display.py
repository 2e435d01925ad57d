"""Queues that give events away, texts of the display, distances on the spheroid, the index of names, and the baseline's report."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberloom.functions import geo
from emberloom.operators import display, live, serve
from emberloom.streaming import dequeue

T0 = datetime(2024, 1, 31)
EVENT = "viewer string, received_at timestamp_ntz, id long, occurred_at timestamp_ntz, category string, fatalities int, reliability double, lat double, lon double, geo_radius_m int"
ASK = "viewer string, at timestamp_ntz, kind string, lat double, lon double, altitude double"


def test_queues_give_away_what_a_plain_queue_does(spark, tmp_path):
    rng = random.Random(3)
    depth, events, asks, turns = 5, [], [], []
    for batch in range(3):
        for k in range(40):
            at = T0 + timedelta(hours=batch, seconds=k)
            viewer = rng.choice(["a", "b"])
            if rng.random() < 0.6:
                row = (viewer, at, rng.randrange(25), T0 - timedelta(hours=rng.randrange(50)), rng.choice(["airstrike", "riot", "odd"]), rng.choice([None, 3, 30]), rng.choice([None, 0.9]), 10.0, 20.0, rng.choice([None, 5000]))
                events.append((batch, row))
                turns.append((batch, viewer, "event", row))
            else:
                kind = "clear" if rng.random() < 0.1 else "take"
                row = (viewer, at, kind, rng.choice([10.0, -60.0]), 20.0, 0.5)
                asks.append((batch, row))
                turns.append((batch, viewer, kind, row))
    priorities = {(r.viewer, r.id, r.received_at): r.p for r in spark.createDataFrame([r for _, r in events], EVENT).withColumn("p", F.round(live.priority(F.col("received_at")), 9)).collect()}
    want, queues = [], {"a": [], "b": []}
    for _, viewer, kind, row in turns:  # in the order of time, which is that of the batches
        q = queues[viewer]
        if kind == "clear":
            q.clear()
        elif kind == "take" and q:
            i, p = q.pop(0)
            want.append((viewer, row[1], i, p, row[3] != 10.0))
        elif kind == "event" and row[2] not in [i for i, _ in q]:
            q.append((row[2], priorities[viewer, row[2], row[1]]))
            q.sort(key=lambda x: -x[1])  # stable: of equals the first stays first
            del q[depth:]

    for batch in range(3):
        for name, rows, schema in (("e", events, EVENT), ("k", asks, ASK)):
            spark.createDataFrame([r for b, r in rows if b == batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        with dequeue.rocksdb(spark):
            read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
            given = dequeue.dequeue(read("e", EVENT), read("k", ASK), depth).writeStream.option("checkpointLocation", str(tmp_path / "at")).format("parquet").option("path", str(tmp_path / "out"))
            given.trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "viewer").collect()]
    assert sorted(got) == sorted(want) and len(want) > 20 and {w[4] for w in want} == {True, False}


def test_texts(spark):
    rows = [(0, "https://WWW.Example.com:80/a?b", 0.4), (29, "http://user:pw@News.org", 59.6), (30, "no url", 60 * 47.4), (90, "ftp://[::1]/x", 60 * 47.6), (3000, "https://www.wwww.de#f", 60 * 24 * 9.6)]
    df = spark.createDataFrame([(k, u, T0 - timedelta(minutes=m)) for k, u, m in rows], "k int, u string, t timestamp_ntz")
    got = df.select(display.outlet(F.col("u")), display.time_ago(F.col("t"), T0), display.utc(F.col("t"))).collect()
    assert [r[0] for r in got] == ["example.com", "news.org", "no url", "[::1]", "wwww.de"]
    assert [r[1] for r in got] == ["0 min ago", "1 h ago", "47 h ago", "2 d ago", "10 d ago"] and got[0][2] == "2024-01-30 23:59 UTC"
    health = spark.createDataFrame([("a", "dead", "x", 1, None), ("b", "degraded", None, 0, None), ("c", None, "e" * 100, 3, None), ("d", "ok", None, 0, T0), ("e", None, None, 0, None)], "source string, credential_status string, last_error string, consecutive_failures int, last_success_at timestamp_ntz")
    assert [tuple(r)[1:] for r in display.feed_label(health, T0).collect()] == [("a: credential dead", True), ("b: auth degraded, retrying", True), ("c: 3 failed — " + "e" * 80 + "…", True), ("d: ok 0 min ago", False), ("e: no data yet", False)]


#: Published and closed-form distances: a survey line, a degree along the equator, quarters of a meridian, and points that are one.
KNOWN = [
    (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777, 54972.271),
    (0.0, 0.0, 0.0, 1.0, 111319.491),
    (0.0, 0.0, 90.0, 0.0, 10001965.729),
    (0.0, 179.5, 0.0, -179.5, 111319.491),
    (12.0, 34.0, 12.0, 34.0, 0.0),
]


def test_distances_on_the_spheroid(spark):
    df = spark.createDataFrame(KNOWN, "a double, b double, c double, d double, m double")
    for r in df.withColumn("got", geo.spheroid_m(*[F.col(c) for c in "abcd"])).collect():
        assert abs(r.got - r.m) < 0.002, r
    assert abs(spark.range(1).select(geo.spheroid_m(*[F.lit(x) for x in (0.0, 0.0, 0.5, 179.7)])).first()[0] - 19_944_127) < 60_000  # almost opposite


@pytest.mark.parametrize("radius", [5_000.0, 10_000.0, 25_000.0])
def test_a_radius_on_the_spheroid_ends_elsewhere(spark, radius):
    """Points whose distance on the sphere and on the spheroid lie on either side of a radius."""
    rows = []
    for k, lat in enumerate((0.0, 30.0, 60.0, 85.0)):
        for share in (0.990, 0.995, 0.999, 1.001, 1.005, 1.010):
            rows.append((len(rows), lat, 10.0 + 40 * k, lat, 10.0 + 40 * k + share * radius / (111_320 * max(0.05, __import__("math").cos(__import__("math").radians(lat))))))
            rows.append((len(rows), lat, 10.0 + 40 * k, lat + share * radius / 111_000, 10.0 + 40 * k))
    all_ = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    base = all_.select("id", F.col("a").alias("lat"), F.col("b").alias("lon"), F.lit(T0).cast("timestamp_ntz").alias("t")).filter("id % 12 = 0")
    ends = all_.select("id", F.col("c").alias("lat"), F.col("d").alias("lon"), F.lit(T0).cast("timestamp_ntz").alias("t"))
    near = lambda spheroid: {(r.id, r.o_id) for r in geo.near_pairs(base, ends, "o_", radius, [radius], 10, 10, spheroid=spheroid).collect()}
    f = geo.spheroid_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    every = base.crossJoin(ends.select(*[F.col(c).alias(f"o_{c}") for c in ends.columns]))
    want = {(r.id, r.o_id) for r in every.filter(f <= radius).collect()}
    assert near(True) == want and near(False) != want and want


def test_names_by_their_letters(spark):
    names = ["Military Forces of Mali", "mali forces", "ML", "Ansar%al", "Ansar al", "İzmir Group", None, "rebels"]
    events = spark.createDataFrame([(k, n, names[-1 - k], None, "x") for k, n in enumerate(names)], "id long, actor_a string, actor_b string, actor_a_canonical string, actor_b_canonical string").withColumn("cluster_id", F.when(F.col("id") < 4, F.lit(7)).cast("long"))
    index = serve.actor_names(events).cache()
    for text in ("mali", "ml", "MALI f", "forces%mali", "ansar_al", " al ", "nobody", "zmi", "%", "x"):
        want = sorted(r[0] for r in serve.members_with_actor(events, text).collect())
        assert sorted(r[0] for r in serve.members_named(events, serve.names_like(index, text)).collect()) == want, text


def test_the_report_without_a_baseline(spark):
    events = spark.createDataFrame([(1, "gdelt", T0, 1.0, 2.0, None)], "id long, source string, occurred_at timestamp_ntz, lat double, lon double, cluster_id long")
    none = serve.baseline_report(events).first()
    assert none.available is False and none.note == serve.NO_BASELINE and none.months_with_data == [] and none.month is None
    some = events.unionByName(events.withColumns({"id": F.lit(2).cast("long"), "source": F.lit("ucdp")})).unionByName(events.withColumns({"id": F.lit(3).cast("long"), "source": F.lit("ucdp"), "occurred_at": F.lit(datetime(2023, 5, 1)).cast("timestamp_ntz")}))
    r = serve.baseline_report(some).first()
    assert (r.available, r.month, r.total, r.matched, r.months_with_data) == (True, "2024-01", 1, 1, ["2023-05", "2024-01"])
    assert serve.baseline_report(some, "2023-05").first().matched == 0
    with pytest.raises(ValueError, match="unconverted"):
        serve.baseline_report(some, "2023-5x")
