"""Feeds read page by page over a function that fetches, alone and several at once."""

import io
import json
import os
import zipfile
from datetime import datetime

import pytest

from emberloom.operators import normalize
from emberloom.sources import live, readers
from emberloom.streaming import ingest, runner

NOW = datetime(2024, 3, 5, 12)
MARKS = "source string, watermark timestamp_ntz, last_success_at timestamp_ntz, last_attempt_at timestamp_ntz, last_error string, consecutive_failures int, records_ingested long"


def clock():
    return NOW


def acled_row(key, day):
    return dict.fromkeys(readers.ACLED_COLUMNS, "") | {"event_id_cnty": key, "event_date": day, "event_type": "Battles", "latitude": "10", "longitude": "20", "geo_precision": "1", "actor1": "Rebels", "country": "Mali"}


def acled_pages(log=None):
    """Seven rows on one day, one on another, two a page."""
    rows = [acled_row(f"A{k}", "2024-03-04") for k in range(7)] + [acled_row("B1", "2024-02-25")]

    def fetch(params):
        since, until = params["event_date"].split("|")
        found = [r for r in rows if since <= r["event_date"] <= until]
        if log:
            with open(log, "a") as f:
                f.write(json.dumps(params) + "\n")
        at = (params["page"] - 1) * params["limit"]
        return {"data": found[at : at + params["limit"]]}

    return fetch


def test_pages_are_read_to_the_first_short_one(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.dataSource.register(live.acled_source(acled_pages(log), clock, page_rows=2))
    rows = spark.read.format("acled").load()
    got = rows.collect()
    assert sorted(r.event_id_cnty for r in got) == [f"A{k}" for k in range(7)] + ["B1"] and rows.columns == list(readers.ACLED_COLUMNS) and got[0].notes == ""
    asked = [json.loads(x) for x in open(log)]
    assert [a["page"] for a in asked if a["event_date"].startswith("2024-03-01")] == [1, 2, 3, 4] and len({a["event_date"] for a in asked}) == 3  # parts of five days
    assert spark.read.format("acled").option("since", "2024-03-01").option("until", "2024-03-04").load().count() == 7
    spark.dataSource.register(live.acled_source(acled_pages(), clock, page_rows=2, most_pages=3))
    with pytest.raises(Exception, match="more than 3 pages"):
        spark.read.format("acled").load().collect()


def test_the_first_page_says_how_many_there_are(spark):
    def fetch(params):
        rows = [{"id": 10 * params["page"] + k, "date_start": params["StartDate"], "latitude": "1.5", "longitude": 2, "type_of_violence": "x", "country": "Mali", "best": 3.0} for k in range(2)]
        return {"TotalPages": 3, "Result": rows}

    spark.dataSource.register(live.ucdp_source(fetch, clock))
    rows = spark.read.format("ucdp").load()
    got = rows.collect()
    assert sorted(r.id for r in got) == [0, 1, 10, 11, 20, 21] and {(r.date_start, r.latitude, r.type_of_violence, r.best, r.relid) for r in got} == {("2023-03-06", 1.5, None, 3, None)}
    assert rows.rdd.getNumPartitions() == 3 and normalize.ucdp(rows)[0].count() == 6
    spark.dataSource.register(live.ucdp_source(fetch, clock, mark=lambda: datetime(2024, 3, 1)))
    assert {r.date_start for r in spark.read.format("ucdp").load().collect()} == {"2024-01-16"}
    spark.dataSource.register(live.ucdp_source(fetch, clock, most_pages=2))
    with pytest.raises(Exception, match="more than 2 pages"):
        spark.read.format("ucdp").load().collect()


def packed(k):
    cells = {0: str(k), 1: "20240304", 6: "REBELS", 26: "195", 28: "19", 51: "4", 52: "Town, Land", 56: "10.0", 57: "20.0", 59: "x", 60: f"https://n{k}.com/a"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.CSV", "\t".join(cells.get(i, "") for i in range(61)) + "\n")
    return out.getvalue()


def gdelt_files(folder):
    """A listing that names the file in `now`; none is an error of the feed."""

    def fetch(params):
        if "listing" in params:
            stamp = open(os.path.join(folder, "now")).read().strip()
            return f"10 aa http://h/{stamp}.mentions.CSV.zip\n10 bb http://h/{stamp}.export.CSV.zip\n" if stamp else ""
        return packed(int(params["url"][9:23]) % 1000)

    return fetch


def test_the_newest_export_is_read_once(spark, tmp_path):
    (tmp_path / "now").write_text("20240304120001")
    spark.dataSource.register(live.gdelt_source(gdelt_files(str(tmp_path))))
    assert [(r.c0, r.c60) for r in spark.read.format("gdelt").load().collect()] == [("1", "https://n1.com/a")]
    seen = []

    def take():
        spark.readStream.format("gdelt").load().writeStream.option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda df, n: seen.append((n, [r.c0 for r in df.collect()]))).trigger(availableNow=True).start().awaitTermination()

    take()
    take()  # the same file isn't read again
    (tmp_path / "now").write_text("20240304121502")
    take()
    assert [x for x in seen if x[1]] == [(0, ["1"]), (seen[-1][0], ["502"])]
    (tmp_path / "now").write_text("")
    with pytest.raises(Exception, match="no export file"):
        spark.read.format("gdelt").load().collect()


def test_hotspots_of_several_data_sets(spark):
    text = {"a": "latitude,longitude,acq_date,acq_time,satellite\n1,2,2024-01-01,5,N\n", "b": "latitude,longitude,acq_date,acq_time,brightness\n1,2,2024-01-01,1205,310\n"}
    spark.dataSource.register(live.firms_source(lambda p: text[p["dataset"]], clock, ("a", "b")))
    got = normalize.firms(spark.read.format("firms").load()).orderBy("acquired_at").collect()
    assert [(r.brightness, r.satellite) for r in got] == [(None, "N"), (310.0, "unknown")]


def test_feeds_run_together_and_a_failure_is_its_own(spark, tmp_path):
    (tmp_path / "now").write_text("")
    spark.dataSource.register(live.acled_source(acled_pages(), clock))
    spark.dataSource.register(live.gdelt_source(gdelt_files(str(tmp_path))))
    hot = "latitude,longitude,acq_date,acq_time,satellite\n10.01,20.0,2024-03-04,1200,N\n"
    spark.dataSource.register(live.firms_source(lambda p: hot, clock, ("one",)))
    store = ingest.Store(spark, str(tmp_path / "store"))
    stream = lambda name: lambda: spark.readStream.format(name).load()
    feeds = [runner.Feed("firms", stream("firms")), runner.Feed("acled", stream("acled"), normalize.acled), runner.Feed("gdelt", stream("gdelt"), normalize.gdelt)]
    run = runner.Runner(store, feeds, str(tmp_path / "offsets"))
    none = spark.createDataFrame([], MARKS)
    try:
        run.run_once()
        marks = {r.source: r for r in run.marks(none, "2024-03-05 12:00:00").collect()}
        assert marks["gdelt"].consecutive_failures == 1 and "no export file" in marks["gdelt"].last_error and marks["gdelt"].records_ingested == 0 and marks["gdelt"].last_success_at is None
        assert (marks["acled"].consecutive_failures, marks["acled"].records_ingested, marks["acled"].last_error) == (0, 8, None) and marks["firms"].records_ingested == 1
        assert store.events().filter("source = 'acled'").count() == 8 and store.clusters().filter("thermal_corroborated").count() >= 1
        assert runner.healthy(run.marks(none, "2024-03-05 12:00:00")).count() == 2
        (tmp_path / "now").write_text("20240304121502")
        run.again.clear()  # its wait is over
        run.run_once()
        marks = {r.source: r for r in run.marks(none, "2024-03-05 12:00:00").collect()}
        assert (marks["gdelt"].consecutive_failures, marks["gdelt"].records_ingested, marks["gdelt"].last_error) == (0, 1, None) and run.failures["gdelt"] == 0
        assert marks["acled"].records_ingested == 8 and store.events().count() == 9  # the window was pulled again, nothing new
    finally:
        run.close()
