import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberloom.functions.text import token_set_ratio
from emberloom.operators import cluster, merge, score, serve
from emberloom.schema import COMPATIBLE, EVENT

SCHEMA = "id long, source string, occurred_at timestamp_ntz, lat double, lon double, geo_precision string, geo_radius_m int, country string, category string, actor_a string, actor_b string, fatalities int, headline string, notes string, source_urls array<string>, reliability double"
T0 = datetime(2024, 1, 1)


def event(k, source="gdelt", hours=0.0, lat=10.0, lon=20.0, category="airstrike", a="Force A", b=None, **more):
    row = dict(id=k, source=source, occurred_at=T0 + timedelta(hours=hours), lat=lat, lon=lon, geo_precision="settlement", geo_radius_m=5000, country="Landia", category=category, actor_a=a, actor_b=b, fatalities=None, headline=None, notes=None, source_urls=[], reliability=None) | more
    return row


def frame(spark, rows):
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def metres(a, b):
    x, y = math.radians(b["lat"] - a["lat"]) / 2, math.radians(b["lon"] - a["lon"]) / 2
    h = math.sin(x) ** 2 + math.cos(math.radians(a["lat"])) * math.cos(math.radians(b["lat"])) * math.sin(y) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h)))


def match(a, b):
    if a["category"] != b["category"] and not any(a["category"] in g and b["category"] in g for g in COMPATIBLE):
        return False
    names = [{x.strip().lower() for x in (e["actor_a"], e["actor_b"]) if x} for e in (a, b)]
    texts = [" ".join(x for x in (e["headline"], e["notes"]) if x).strip().lower() for e in (a, b)]
    return bool(names[0]) and names[0] == names[1] or all(texts) and token_set_ratio(*texts) > 55


def replay(rows):
    """Cluster ids by walking through the reports one by one, in the order given."""
    found = {}
    for k, e in enumerate(rows):
        near = [(round(metres(e, o), 3), n, o) for n, o in enumerate(rows[:k]) if abs((e["occurred_at"] - o["occurred_at"]).total_seconds()) <= cluster.WINDOW_S and metres(e, o) <= max(cluster.LEAST_RADIUS_M, e["geo_radius_m"] or 0, o["geo_radius_m"] or 0)]
        parent = next((o for _, _, o in sorted(near, key=lambda x: x[:2])[: cluster.CANDIDATES] if match(e, o)), None)
        found[e["id"]] = found[parent["id"]] if parent else e["id"]
    return found


def reports(rng, n, spread=1.0):
    rows = []
    for k in range(n):
        p = rng.choice([("settlement", 5000), ("admin2", 25_000), ("admin1", 60_000), ("country", 250_000)])
        rows.append(event(k, hours=rng.choice([0, 0, 3, 6, 9, 24]), lat=10 + rng.choice([0, 0.05, 0.2, 1.5]) * rng.random() * spread, lon=20 + rng.random() * 0.3 * spread, category=rng.choice(["airstrike", "artillery", "protest"]), a=rng.choice(["Force A", "force a ", "Force B", None]), b=rng.choice([None, "Force B"]), notes=rng.choice([None, "shelling near the old bridge", "old bridge hit by shelling", "market day"]), geo_precision=p[0], geo_radius_m=p[1]))
    return rows


def test_forest_is_the_sequential_replay(spark):
    rows = reports(random.Random(11), 140)
    want = replay(rows)
    got = {r.id: r.cluster_id for r in cluster.assign_clusters(frame(spark, rows)).collect()}
    assert got == want and 1 < len(set(got.values())) < 140
    stored = cluster.assign_clusters(frame(spark, rows[:90]))
    later = cluster.assign_batch(stored, frame(spark, rows[90:]))
    assert {r.id: r.cluster_id for r in stored.select("id", "cluster_id").union(later.select("id", "cluster_id")).collect()} == want


def test_random_batches_are_one_batch_whatever_the_ids(spark):
    """Ids are hashes: what arrives first may have the larger one."""
    rng = random.Random(23)
    rows = reports(rng, 90)
    for r, k in zip(rows, rng.sample(range(10_000), len(rows)), strict=True):
        r["id"] = k
    want = replay(rows)
    cuts = sorted(rng.sample(range(1, 90), 2))
    placed = lambda part, n: frame(spark, part).join(spark.createDataFrame([(r["id"], (n, k)) for k, r in enumerate(part)], "id long, arrival struct<batch:bigint,place:bigint>"), "id")
    stored = None
    for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, 90], strict=True)):
        part = placed(rows[i:j], n)
        new = cluster.assign_clusters(part) if stored is None else cluster.assign_batch(stored, part)
        stored = cluster.checkpoint(new if stored is None else stored.unionByName(new.select(*stored.columns)))
    assert {r.id: r.cluster_id for r in stored.collect()} == want


def test_a_city_on_one_instant_meets_its_first_reports_only(spark):
    rows = [event(k, a=f"Force {k % 60}") for k in range(400)]
    got = cluster.candidates(frame(spark, rows))
    assert got.agg(F.max("rn")).first()[0] == 50 and got.filter("cand_id >= 50").count() == 0
    assert {r.id: r.cluster_id for r in cluster.assign_clusters(frame(spark, rows), text_rule=False).collect()} == replay(rows)


def test_the_score_is_written_back_to_who_speaks(spark):
    e = frame(spark, [event(1, reliability=0.1), event(2, reliability=0.2)])
    c = spark.createDataFrame([(1, 2, 0.9)], "cluster_id long, representative long, reliability double")
    assert {r.id: r.reliability for r in cluster.write_back(e, c).collect()} == {1: 0.1, 2: 0.9}


def test_cross_source_join(spark):
    rows = [event(1, "gdelt"), event(2, "acled", hours=2, fatalities=5), event(3, "gdelt", category="protest"), event(4, "gdelt", lat=14.0), event(5, "gdelt", hours=7)]
    e = cluster.assign_clusters(frame(spark, rows))
    c = {r.cluster_id: r for r in cluster.cluster_stats(e).collect()}
    assert c[1].member_count == 3 and c[1].representative == 2 and set(c) == {1, 3, 4}
    s = {r.cluster_id: r for r in score.score_clusters(e, cluster.cluster_stats(e).withColumn("thermal_corroborated", F.lit(False))).collect()}
    assert s[1].reliability == 0.75 and s[3].reliability is None and "ACLED-curated record" in s[1].explanation
    assert s[3].explanation == "single GDELT report, uncorroborated"


def test_many_outlets_are_one_incident(spark):
    rows = [event(k, source_urls=[f"https://www.outlet{k}.example{k}.com/x"], fatalities=3) for k in range(8)]
    e = cluster.assign_clusters(frame(spark, rows))
    c = score.score_clusters(e, cluster.cluster_stats(e).withColumn("thermal_corroborated", F.lit(True))).first()
    assert c.member_count == 8 and c.reliability == 0.75  # 0.35 + 0.15 + 0.05 + 0.15 + 0.05
    assert c.explanation == "8 independent outlets; thermal signature corroborated; sources agree on fatalities"


def test_corroboration(spark):
    e = frame(spark, [event(1), event(2, hours=12.5, lat=50.0), event(3, category="protest", lat=-30.0)]).withColumn("cluster_id", F.col("id"))
    at = lambda h, lat: (T0 + timedelta(hours=h), lat, 20.01)
    hot = lambda *rows: spark.createDataFrame(list(rows), "acquired_at timestamp_ntz, lat double, lon double")
    found = lambda h: {r.cluster_id for r in score.corroborated(e, h).collect()}
    assert found(hot(at(29, 10.0), at(18, 50.0), at(0, -30.0))) == {1, 2}
    assert found(hot(at(31, 10.0), at(20, 50.0), at(0, 10.5))) == set()
    c = spark.createDataFrame([(1, True), (2, None)], "cluster_id long, thermal_corroborated boolean")
    assert {r.cluster_id: r.thermal_corroborated for r in score.mark_thermal(c, spark.createDataFrame([], "cluster_id long")).collect()} == {1: True, 2: False}


def test_revision_changes_in_place(spark):
    stored = frame(spark, [event(1, "acled", fatalities=1)]).withColumns({"source_event_id": F.lit("A1"), "cluster_id": F.lit(7)})
    columns = [f.name for f in EVENT.fields]
    add = {c: F.lit(None).cast(EVENT[c].dataType) for c in columns if c not in stored.columns}
    stored = stored.withColumns(add)
    batch = stored.withColumns({"fatalities": F.lit(9), "batch_pos": F.lit(1)}).select(*columns, "batch_pos")
    batch = batch.unionByName(batch.withColumns({"fatalities": F.lit(4), "batch_pos": F.lit(2)})).unionByName(batch.withColumn("source_event_id", F.lit("A2")))
    got = {r.source_event_id: r for r in merge.upsert(stored, batch).collect()}
    assert got["A1"].fatalities == 4 and got["A1"].cluster_id == 7 and got["A1"].id == 1 and got["A2"].id is None
    assert [r.source_event_id for r in merge.inserted(stored, batch).collect()] == ["A2"]


def test_list_filters_and_errors(spark):
    import pytest

    rows = [event(1, a="Force A", hours=1), event(2, a="Other", hours=2, reliability=0.9), event(3, a="X", lat=60.0)]
    e = frame(spark, rows).withColumn("cluster_id", F.expr("CASE WHEN id < 3 THEN 1 END"))
    c = cluster.cluster_stats(e.filter("cluster_id is not null")).withColumn("thermal_corroborated", F.lit(None).cast("boolean"))
    now = T0 + timedelta(days=1)
    ids = lambda **q: [r.id for r in serve.list_events(e, c, serve.EventQuery(now, **q)).collect()]
    assert ids() == [1, 3] and ids(actor="other") == [1] and ids(bbox="0,50,40,70") == [3] and ids(min_reliability=0.5) == []
    assert ids(countries=("LANDIA",), categories=("airstrike",), limit=1) == [1] and ids(since=now) == []
    for bad in ({"categories": ("war",)}, {"actor": "x"}, {"limit": 0}):
        with pytest.raises(ValueError):
            serve.EventQuery(now, **bad)
    with pytest.raises(ValueError):
        ids(bbox="1,2,3")
    plan = serve.list_events(e, c, serve.EventQuery(now, actor="other"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def nearest_plainly(rows, most):
    """(id, cand) of each report's nearest earlier ones, by comparing all."""
    import numpy as np

    lat, lon = (np.radians([r[k] for r in rows]) for k in (1, 2))
    t, reach = np.array([r[3].timestamp() for r in rows]), np.maximum(10_000.0, [r[4] for r in rows])
    out = set()
    for i in range(len(rows)):
        h = np.sin((lat[:i] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[:i]) * np.sin((lon[:i] - lon[i]) / 2) ** 2
        d = 2 * 6_371_008.8 * np.arcsin(np.sqrt(np.minimum(1, h)))
        ok = np.flatnonzero((np.abs(t[:i] - t[i]) <= 6 * 3600) & (d <= np.maximum(reach[:i], reach[i])))
        order = sorted(ok, key=lambda j: (round(float(d[j]), 3), j))
        out |= {(i, int(j)) for j in order[:most]}
    return out


def test_crowds_are_searched_ring_by_ring(spark):
    """A city of reports side by side, one of them far denser, with others around it: the candidates are those of comparing all."""
    rng = random.Random(21)
    t0, rows = datetime(2024, 1, 1, 12), []
    for i in range(1500):
        kind = rng.random()
        spread = 0.03 if kind < 0.5 else 0.0004 if kind < 0.85 else 0.4
        rows.append((i, 10 + rng.gauss(0, spread), 20 + rng.gauss(0, spread), t0 + timedelta(minutes=rng.randrange(0, 900)), rng.choice([5_000, 5_000, 5_000, 25_000, 60_000])))
    df = spark.createDataFrame(rows, "id long, lat double, lon double, occurred_at timestamp, geo_radius_m int").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    want = nearest_plainly(rows, 10)
    for dense in (40, 10**9):
        got = {(r.id, r.cand_id) for r in cluster.candidates(df, 10, dense=dense).collect()}
        assert got == want
    radii = [10_000.0, 25_000.0, 60_000.0, 250_000.0]
    few = cluster.narrow(df, radii)
    many = cluster.crowded(few, few, 40)
    found, rest = cluster.nearest_in_crowds(few, many, 10, 40)
    assert found.select("id").distinct().count() > 800 and rest.count() + found.select("id").distinct().count() == many.count()
    batch = df.filter("id >= 1200")  # a batch after what is stored
    got = {(r.id, r.cand_id) for r in cluster.candidates(df, 10, later=batch, dense=40).collect()}
    assert got == {(i, j) for i, j in want if i >= 1200}


def test_reports_in_crowds_are_searched_by_cells(spark):
    """Cells as groups find what joins find, and of the candidates of a crowd no more leave a cell than can be parents."""
    rows = [r | {"lat": 10 + round(r["lat"] - 10, 2), "lon": 20 + round(r["lon"] - 20, 1)} for r in reports(random.Random(5), 260)]
    df = frame(spark, rows)
    kept = lambda d: sorted((r.id, r.cand_id, r.rn, r.distance_m) for r in d.collect())
    want = kept(cluster.candidates(df, 10, crowd=10**9))
    plain, in_cells = cluster.candidate_parts(df, 10, None, 10**9, 20)
    assert in_cells.count() > 1000 and kept(cluster.candidates(df, 10, crowd=20)) == want
    for rule in (True, False):
        found = lambda crowd: {r.id: r.parent for r in cluster.parents(df, rule, 10, crowd=crowd).collect()}  # noqa: B023, E731
        assert found(20) == found(10**9) and len(found(20)) > 100
    _, one = cluster.candidate_parts(df.withColumns({"kind": F.col("category"), "mask": F.lit(0).cast("long"), "actors": F.col("actor_a"), "told": F.lit(False)}), 10, None, 10**9, 20, "same")
    assert one.count() == one.select("id").distinct().count() < in_cells.count()


def test_corroboration_compares_places_once(spark):
    """Hotspots of one place and reports of one place and time are one row each where they meet."""
    rows = [event(k, hours=(0, 5)[k % 2], lat=10.0 + k % 3) for k in range(60)]
    e = frame(spark, rows).withColumn("cluster_id", F.col("id"))
    h = spark.createDataFrame([(T0 + timedelta(hours=20, minutes=k), 10.0, 20.01) for k in range(50)] + [(T0 + timedelta(hours=11, minutes=-k), 11.0, 20.01) for k in range(50)], "acquired_at timestamp_ntz, lat double, lon double")
    found = score.corroborated(e, h)
    assert {r.cluster_id for r in found.collect()} == {k for k in range(60) if k % 3 == 0 and k % 2 == 0 or k % 3 == 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan


def test_heat_beside_a_report_is_one_lookup(spark):
    """Reports and hotspots side by side aren't compared; at random, with times on the edges of windows and buckets, the result is that of comparing all."""
    rng = random.Random(8)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    hot = lambda rows: spark.createDataFrame(rows, "acquired_at timestamp_ntz, lat double, lon double")
    at = lambda h, us=0: T0 + timedelta(hours=h, microseconds=us)
    e = frame(spark, [event(k, hours=1 + k % 5) for k in range(40)]).withColumn("cluster_id", F.col("id"))
    found = score.corroborated(e, hot([(at(3, k), 10.0, 20.0) for k in range(30)]))
    assert found.count() == 40 and "ASIN" not in plan(found).upper()
    rows = [event(k, hours=rng.choice([0, 5, 6, 7.5, 18, 24, 30, 36, 48, 59.999999]), lat=10.0 + rng.choice([0, 0.02, 0.04, 0.3]), lon=20.0 + rng.choice([0, 0.01, 0.06]), category=rng.choice(["airstrike", "protest", "ied"])) for k in range(150)]
    places = [(at(rng.choice([-7, -6, 0, 5, 12, 17, 24, 29, 30, 42, 54, 66]), rng.choice([-1, 0, 1])), 10.0 + rng.choice([0, 0.03, 0.05]), 20.0 + rng.choice([0, 0.05])) for _ in range(25)]
    want = set()
    for r in rows:
        until = 30 if r["occurred_at"].time() == datetime.min.time() else 6
        if r["category"] != "protest" and any(-6 * 3600 <= (t - r["occurred_at"]).total_seconds() <= until * 3600 and metres(r, {"lat": lat, "lon": lon}) <= 5000 for t, lat, lon in places):
            want.add(r["id"])
    odd = frame(spark, [event(900, lat=float("nan")), event(901, lat=None), event(902, hours=1000)])
    got = score.corroborated(frame(spark, rows).unionByName(odd).withColumn("cluster_id", F.col("id")), hot([*places, (T0, float("nan"), 20.0), (None, 10.0, 20.0)]))
    assert {r.cluster_id for r in got.collect()} == want and 20 < len(want) < 120


def test_wide_radii_are_searched_by_cells_where_joins_compare_much(spark):
    """Places a degree apart, each with a few reports of a country's radius: no narrow cell is a crowd, yet a join would meet them all."""
    rng = random.Random(4)
    rows = [event(k, hours=rng.choice([0, 0, 5, 24]), lat=float(10 + k % 5), lon=float(20 + k % 3), category=rng.choice(["airstrike", "protest"]), a=f"Force {rng.randrange(9)}", geo_radius_m=rng.choice([5000, 60_000, 250_000, 250_000])) for k in range(240)]
    df = frame(spark, rows)
    assert cluster.crowding(cluster.narrow(df, [10_000.0, 25_000.0, 60_000.0, 250_000.0]), 10, [10_000.0, 25_000.0, 60_000.0, 250_000.0])[-1] > 5000
    kept = lambda d: sorted((r.id, r.cand_id, r.rn, r.distance_m) for r in d.collect())
    plain, none = cluster.candidate_parts(df, 10, None, 10**9, 10**9, compared=10**9)
    rest, in_cells = cluster.candidate_parts(df, 10, None, 10**9, 40, compared=100)
    assert none is None and in_cells.count() > 1000
    assert kept(in_cells.drop("same") if rest is None else rest.unionByName(in_cells.drop("same"))) == kept(plain)


def test_texts_that_come_again_are_remembered(spark):
    from emberloom.functions import text

    text.seen_ratio.cache_clear()
    assert text.seen_ratio("a b", "a c") == text.seen_ratio("a b", "a c") == token_set_ratio("a b", "a c") and text.seen_ratio.cache_info().hits == 1
    long = "word " * 200
    df = spark.createDataFrame([("a b", "a c"), ("a b", None), (long, "a b"), ("a b", "a c")], "a string, b string")
    assert [r.s for r in df.select(text.token_set_ratio_column(F.col("a"), F.col("b")).alias("s")).collect()] == [token_set_ratio(a, b) for a, b in [("a b", "a c"), ("a b", None), (long, "a b"), ("a b", "a c")]]
