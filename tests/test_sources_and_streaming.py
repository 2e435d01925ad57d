import json
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberloom.operators import live, normalize
from emberloom.sources import readers
from emberloom.streaming import ingest


def test_acled_pages(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"status": 200, "data": [{"event_id_cnty": f"A{k}", "event_date": f"2024-01-0{k + 1}", "latitude": "1", "longitude": "2", "other": 1}]}))
    rows = readers.read_acled(spark, str(tmp_path))
    assert rows.columns == list(readers.ACLED_COLUMNS) and rows.count() == 2
    assert [r.event_id_cnty for r in readers.read_acled(spark, str(tmp_path), "2024-01-02", "2024-01-09").collect()] == ["A1"]


def test_ucdp_pages(spark, tmp_path):
    row = {"id": 5, "date_start": "2024-02-03T00:00:00", "latitude": 1.5, "longitude": 2.5, "type_of_violence": 1, "best": 3}
    (tmp_path / "p1.json").write_text(json.dumps({"TotalPages": 2, "Result": [row, row | {"id": 6, "date_start": "2024-03-04"}]}))
    rows = readers.read_ucdp(spark, str(tmp_path))
    assert rows.count() == 2 and normalize.ucdp(rows)[0].count() == 2
    assert str(readers.ucdp_watermark(rows).first().watermark) == "2024-03-04 00:00:00"
    with pytest.raises(ValueError, match="more than 1 pages"):
        readers.read_ucdp(spark, str(tmp_path), most_pages=1)


def test_firms_files_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,bright_ti4,frp,confidence\n1,2,2024-01-01,5,N,300,1,n\n")
    (tmp_path / "b.csv").write_text("latitude,longitude,acq_date,acq_time,brightness\n1,2,2024-01-01,1205,310\n")
    got = normalize.firms(readers.read_firms(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])).orderBy("acquired_at").collect()
    assert [(r.brightness, r.satellite) for r in got] == [(300.0, "N"), (310.0, "unknown")]


def test_listing_and_export(spark, tmp_path):
    listing = spark.createDataFrame([("10 aa http://h/20240305120000.export.CSV.zip",), ("10 bb http://h/20240305120000.mentions.CSV.zip",), ("odd",)], "value string")
    assert [(r.url[-28:], str(r.stamp)) for r in readers.newest_listing(listing).collect()] == [("20240305120000.export.CSV.zip"[-28:], "2024-03-05 12:00:00")]
    (tmp_path / "x.CSV").write_text("\t".join(f'v"{k}' for k in range(61)) + "\n" + "short\tline\n")
    rows = readers.read_gdelt(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].c60 == 'v"60' and rows[1].c60 is None


def test_dimension_tables(spark):
    assert readers.weapons_table(spark).count() == 35 and readers.actors_table(spark).count() == 28 and readers.countries_table(spark).count() == 99


def lines(ids, code="195"):
    return [tuple({0: str(k), 1: "20240305", 6: "REBELS", 26: code, 28: code[:2], 51: "4", 52: "Town, Land", 56: "10.0", 57: "20.0", 59: "x", 60: f"https://n{k}.com/a"}.get(i, "") for i in range(61)) for k in ids]


def rows_of(spark, ids, **k):
    return normalize.gdelt(spark.createDataFrame(lines(ids, **k), readers.GDELT_SCHEMA))


def test_two_batches_are_one_and_revisions_stay_in_place(spark, tmp_path):
    published = []
    store = ingest.Store(spark, str(tmp_path / "store"))
    publish = lambda df, n: published.append((n, [json.loads(r.value) for r in df.collect()]))
    ingest.merge_batch(store, rows_of(spark, [1, 2, 3])[0], 0, publish)
    before = {r.source_event_id: (r.id, r.cluster_id) for r in store.events().collect()}
    ingest.merge_batch(store, rows_of(spark, [3], code="194")[0].unionByName(rows_of(spark, [4])[0]), 1, publish)
    after = {r.source_event_id: r for r in store.events().collect()}
    assert [(n, len(p)) for n, p in published] == [(0, 3), (1, 1)] and after["3"].category == "artillery" and '"EventCode":"194"' in after["3"].raw_payload
    assert {k: (after[k].id, after[k].cluster_id) for k in before} == before
    # the payload is the whole card, over all members of the cluster
    card = published[1][1][0]
    assert card["source_count"] == 4 and len(card["source_urls"]) == 4 and card["reliability_explanation"] == "4 independent outlets" and card["reliability"] == 0.55 and "origin_lat" not in {k for k, v in card.items() if v}
    once = ingest.Store(spark, str(tmp_path / "once"))
    for _ in range(2):  # a batch that runs again changes nothing
        ingest.merge_batch(once, rows_of(spark, [1, 2, 3, 4])[0], 0)
    key = lambda s: sorted((r.id, r.cluster_id) for r in s.events().collect())
    assert key(once) == key(store) and once.rows("runs").count() == 1


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.merge_batch(store, rows_of(spark, [1, 2])[0], 0)
    for ids in ([3, 4, 5], [3, 4]):
        ingest.merge_batch(store, rows_of(spark, ids)[0], 1)
    assert sorted(r.source_event_id for r in store.events().collect()) == ["1", "2", "3", "4"]
    assert {(r.source, r.new_records) for r in store.rows("runs").collect()} == {("gdelt", 2)}
    marks = spark.createDataFrame([("gdelt", None, None, None, "old", 2, 10)], "source string, watermark timestamp_ntz, last_success_at timestamp_ntz, last_attempt_at timestamp_ntz, last_error string, consecutive_failures int, records_ingested long")
    assert ingest.feed_marks(store, marks, "2024-01-01 00:00:00").first().records_ingested == 14


def test_a_failing_sink_leaves_the_batch_stored(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))

    def broken(df, n):
        raise OSError("no sink")

    ingest.merge_batch(store, rows_of(spark, [1])[0], 0, broken)
    assert store.events().count() == 1 and store.clusters().count() == 1


def test_rejects_and_counts_are_kept(spark, tmp_path):
    bad = [tuple("99.5x" if k == 1 else v for k, v in enumerate(r)) for r in lines([7])]
    raw = spark.createDataFrame(lines([1, 2]) + bad, readers.GDELT_SCHEMA)
    raw.coalesce(1).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(str(tmp_path / "in"))
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.stream_events(readers.stream_gdelt(spark, str(tmp_path / "in")), normalize.gdelt, store, str(tmp_path / "offsets")).awaitTermination()
    assert [(r.source_event_id, r.reason) for r in store.rows("rejects").collect()] == [("7", "bad date")]
    r = store.rows("runs").first()
    assert (r.source, r.fetched, r.normalized, r.new_records) == ("gdelt", 3, 2, 2)


def test_hotspots_corroborate_what_is_stored(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.merge_batch(store, rows_of(spark, [1, 2])[0], 0)
    assert {(r.thermal_corroborated, r.reliability) for r in store.clusters().collect()} == {(False, 0.45)}
    (tmp_path / "hot").mkdir()
    (tmp_path / "hot" / "a.csv").write_text("latitude,longitude,acq_date,acq_time,satellite\n10.01,20.0,2024-03-05,1200,N\n10.01,20.0,2024-03-05,1200,N\n50,20,2024-03-05,1200,N\n")
    schema = ", ".join(f"{c} string" for c in ("latitude", "longitude", "acq_date", "acq_time", "satellite"))

    def stream():
        hot = spark.readStream.schema(schema).option("header", True).csv(str(tmp_path / "hot"))
        for c in readers.FIRMS_COLUMNS:
            if c not in hot.columns:
                hot = hot.withColumn(c, F.lit(None).cast("string"))
        ingest.stream_hotspots(hot, store, str(tmp_path / "hot-offsets")).awaitTermination()

    stream()
    assert store.hotspots().count() == 2
    assert {(r.thermal_corroborated, r.reliability) for r in store.clusters().collect()} == {(True, 0.6)}
    # the mark stays when the cluster grows
    ingest.merge_batch(store, rows_of(spark, [3])[0], 1)
    assert {(r.member_count, r.thermal_corroborated) for r in store.clusters().collect()} == {(3, True)}
    (tmp_path / "hot" / "b.csv").write_text("latitude,longitude,acq_date,acq_time,satellite\n10.01,20.0,2024-03-05,1200,N\n")
    stream()
    assert store.hotspots().count() == 2


def test_reports_are_enriched_as_they_come(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    row = dict.fromkeys(readers.ACLED_COLUMNS, "") | {"event_date": "2024-03-05", "event_type": "Explosions/Remote violence", "sub_event_type": "Air/drone strike", "latitude": "10", "longitude": "20", "geo_precision": "1", "country": "Ukraine"}
    acled = [row | {"event_id_cnty": "A1", "actor1": "Military Forces of Russia (2000-)", "notes": "A HIMARS strike hit the depot"}, row | {"event_id_cnty": "A2", "actor1": "Other", "notes": "himars strike hit the depot, reports say"}]
    for n, r in enumerate(acled):  # texts alike, actors not: the text rule joins them across batches
        ingest.merge_batch(store, normalize.acled(spark.createDataFrame([r], ", ".join(f"{c} string" for c in readers.ACLED_COLUMNS)))[0], n, feed="acled")
    got = {r.source_event_id: r for r in store.events().collect()}
    assert got["A1"].cluster_id == got["A2"].cluster_id == got["A1"].id
    assert got["A1"].origin_country == "Russia" and got["A2"].origin_country is None and got["A1"].actor_a_canonical == "Military Forces of Russia (2000-)"
    assert {r.weapon_key for r in store.weapons().collect()} == {"himars"}


def test_stream_takes_files_in_batches(spark, tmp_path):
    raw = spark.createDataFrame(lines(range(6)), readers.GDELT_SCHEMA)
    got = ingest.replay(raw, parts=3, path=str(tmp_path / "replay"))
    assert got.count() == 6 and got.agg(F.count_distinct("cluster_id")).first()[0] >= 1
    assert ingest.cadence("gdelt") == "900 seconds"


def test_zipped_exports_listings_and_windows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "20240305120000.export.CSV.zip", "w") as z:
        z.writestr("20240305120000.export.CSV", b"\xff1\t2\n" + "\t".join(str(k) for k in range(61)).encode() + b"\n\n")
    rows = readers.read_gdelt_zip(spark, str(tmp_path / "*.zip")).collect()
    assert [(r.c0, r.c1, r.c60) for r in rows] == [("\ufffd1", "2", None), ("0", "1", "60")]
    listing = spark.createDataFrame([("1 a http://h/20240305120000.export.CSV.zip",), ("1 a http://h/20240305121500.export.CSV.zip",)], "value string").coalesce(1)
    assert [str(r.stamp) for r in readers.next_export(listing, datetime(2024, 3, 5, 11)).collect()] == ["2024-03-05 12:00:00"]
    assert readers.next_export(listing, datetime(2024, 3, 5, 12)).count() == 0
    with pytest.raises(ValueError, match="no export file"):
        readers.next_export(listing.limit(0))
    assert str(readers.ucdp_start(datetime(2024, 3, 5))) == "2023-03-06" and str(readers.ucdp_start(datetime(2024, 3, 5), datetime(2024, 3, 1))) == "2024-01-16"
    some = spark.createDataFrame([("2024-01-15T00:00:00",), ("2024-01-16",), ("odd",)], "date_start string")
    assert sorted(r[0] for r in readers.since_date(some, readers.ucdp_start(datetime(2024, 3, 5), datetime(2024, 3, 1))).collect()) == ["2024-01-16", "odd"]


def test_the_queue_of_a_stream_is_that_of_all_its_events(spark, tmp_path):
    at, schema = datetime(2024, 1, 31), "id long, occurred_at timestamp_ntz, fatalities int, reliability double, category string, received_at timestamp_ntz"
    rng = random.Random(6)
    rows = [(rng.randrange(60), datetime(2024, 1, 1 + rng.randrange(30)), rng.randrange(40), rng.random(), rng.choice(["airstrike", "riot", "other"]), at) for _ in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = {}

    def keep(df, n):
        found = df.collect()
        for shard in {r.shard for r in found}:
            parts[shard] = [r for r in found if r.shard == shard]

    live.queue_stream(stream, depth=10, shards=3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "offsets")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert len(parts) == 3 and all(len(p) <= 10 and [r.place for r in p] == list(range(1, len(p) + 1)) for p in parts.values())
    head = live.queue_head(spark.createDataFrame([tuple(r) for p in parts.values() for r in p], "shard int, place int, id long, priority double"), 10).collect()
    assert len(head) == 10 and len({r.id for r in head}) == 10
    # an event that no other state of it came before has the priority of its own row
    single = [i for i in {r[0] for r in rows} if sum(r[0] == i for r in rows) == 1]
    best = {r.id: r.priority for r in live.live_queue(spark.createDataFrame(rows, schema), at, 90).collect()}
    assert all(abs(best[r.id] - r.priority) < 1e-9 for r in head if r.id in single) and min(r.priority for r in head) >= sorted((best[i] for i in single), reverse=True)[10 - 1] - 1e-9


def test_a_batch_of_several_files_is_in_the_order_of_their_names(spark, tmp_path):
    """Tasks take files by size; the place of a row in its batch follows the files' names and their lines."""
    from emberloom.operators import cluster

    sizes = (3, 40, 11)
    for k, n in enumerate(sizes):
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{100 * k + j},{'x' * n}\n" for j in range(n)))
    rows = spark.read.schema("c0 long, c1 string").csv(str(tmp_path))
    got = ingest.in_order(cluster.checkpoint(ingest.told_place(rows).withColumn("batch_pos", F.monotonically_increasing_id())))
    assert got.columns == ["c0", "c1", "batch_pos"]
    assert [r.c0 for r in got.orderBy("batch_pos").collect()] == [100 * k + j for k, n in enumerate(sizes) for j in range(n)]


def test_a_few_names_leave_no_few_tasks(spark):
    """Names of all reports meet what is known of them where the reports are."""
    from emberloom.operators import enrich

    e = spark.range(40).repartition(5).select(F.lit("gdelt").alias("source"), F.lit("MILITARY").alias("actor_a"), F.lit(None).cast("string").alias("actor_b"))
    out = enrich.canonicalize(e)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 40
