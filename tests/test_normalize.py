import pytest

from emberloom.operators import normalize
from emberloom.sources.readers import ACLED_COLUMNS, FIRMS_COLUMNS, GDELT_SCHEMA, UCDP_ROW

ACLED = dict(zip(ACLED_COLUMNS, ("AFG1", "2024-03-05", "Explosions/Remote violence", "Air/drone strike", "Force A", "", "Landia", "North", "Oldtown", "34.5", "69.1", "1", "3", "A note", None), strict=True))


def acled(spark, **change):
    row = ACLED | change
    return normalize.acled(spark.createDataFrame([tuple(row[c] for c in ACLED_COLUMNS)], ", ".join(f"{c} string" for c in ACLED_COLUMNS)))


def gdelt(spark, **change):
    row = {f"c{i}": "" for i in range(61)} | {"c0": "77", "c1": "20240305", "c6": "REBELS", "c16": "", "c26": "195", "c28": "19", "c51": "4", "c52": "Oldtown, North, Landia", "c56": "34.5", "c57": "69.1", "c59": "20240305120000", "c60": "https://news.example.com/a"} | change
    return normalize.gdelt(spark.createDataFrame([tuple(row.values())], GDELT_SCHEMA))


def test_acled_row(spark):
    r = acled(spark)[0].first()
    assert (r.category, r.geo_precision, r.geo_radius_m, r.fatalities, r.actor_b) == ("airstrike", "settlement", 5000, 3, None)
    assert r.raw_event_type == "Explosions/Remote violence/Air/drone strike" and str(r.occurred_at) == "2024-03-05 00:00:00"


def test_acled_drones_and_defaults(spark):
    assert acled(spark, tags="uses Drone")[0].first().category == "drone_strike"
    assert acled(spark, sub_event_type="?", event_type="?")[0].first().category == "other_violence"
    assert acled(spark, geo_precision="x")[0].first().geo_precision == "admin2"
    assert acled(spark, latitude=None)[0].count() == 0


def test_rejects_and_strict(spark):
    events, rejects = acled(spark, event_date="someday")
    assert events.count() == 0 and rejects.first().reason == "bad date"
    assert acled(spark, latitude="95")[1].first().reason == "place out of range"
    row = ACLED | {"event_date": "someday"}
    bad = spark.createDataFrame([tuple(row[c] for c in ACLED_COLUMNS)], ", ".join(f"{c} string" for c in ACLED_COLUMNS))
    with pytest.raises(Exception, match="row refused"):
        normalize.acled(bad, strict=True)[0].collect()


def test_gdelt_row(spark):
    r = gdelt(spark)[0].first()
    assert (r.category, r.geo_precision, r.country, r.admin1, r.location_name, r.source_urls) == ("airstrike", "settlement", "Landia", "North", "Oldtown", ["https://news.example.com/a"])


@pytest.mark.parametrize(("change", "kept"), [({"c28": "01", "c26": "010"}, 0), ({"c28": "14", "c26": "145"}, 1), ({"c51": "0"}, 0), ({"c56": ""}, 0), ({"c51": "?"}, 1)])
def test_gdelt_noise(spark, change, kept):
    assert gdelt(spark, **change)[0].count() == kept


@pytest.mark.parametrize(("code", "root", "category"), [("1831", "18", "ied"), ("181", "18", "abduction"), ("190", "19", "ground_assault"), ("1451", "14", "riot"), ("202", "20", "other_violence")])
def test_gdelt_categories(spark, code, root, category):
    assert gdelt(spark, c26=code, c28=root)[0].first().category == category


def test_ucdp(spark):
    row = (9, "r", "2024-02-01T00:00:00", None, 10.0, 20.0, 1, "spot", "Landia", "", 2, "Gov", "Reb", 4, "Gov - Reb", "head")
    r = normalize.ucdp(spark.createDataFrame([row], UCDP_ROW))[0].first()
    assert (r.category, r.raw_event_type, r.geo_precision, r.fatalities, r.headline, r.admin1) == ("ground_assault", "non-state conflict", "settlement", 4, "Gov - Reb", None)
    assert normalize.ucdp(spark.createDataFrame([(*row[:2], "soon", *row[3:])], UCDP_ROW))[0].count() == 0


def test_firms(spark):
    schema = ", ".join(f"{c} string" for c in FIRMS_COLUMNS)
    rows = [("1.5", "2.5", "2024-01-01", "7", None, None, "301", "x", "n"), ("1.5", "2.5", "2024-01-01", "2561", "N", "300", None, "2", "n")]
    got = normalize.firms(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and str(got[0].acquired_at) == "2024-01-01 00:07:00" and got[0].satellite == "unknown" and got[0].brightness == 301 and got[0].frp is None
