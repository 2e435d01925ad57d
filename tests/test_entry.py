import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    r = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(norm(x[columns.index(k)]) for k in sorted(columns)) for x in r.fetchall()]
    got = [tuple(norm(x[k]) for k in sorted(columns)) for x in df.collect()]
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_whole_match_rule_gives_the_clusters_of_a_plain_replay(spark):
    """The queries without SQL: reports one by one, each after its nearest matching earlier one."""
    from emberloom.plans import fixtures
    from tests.test_cluster_and_score import replay

    e = fixtures.events(spark, SF).filter("id < 500")
    rows = [r.asDict() for r in e.orderBy("id").collect()]
    want = replay(rows)
    from emberloom.operators import cluster

    assert {r.id: r.cluster_id for r in cluster.assign_clusters(e).collect()} == want
    got = {r.id: r.cluster_id for r in entry.queries()["cluster_assign_text"](spark, SF).collect()}
    assert {k: v for k, v in got.items() if k < 500} == want  # later reports change nothing
    plain = {r.id: r.cluster_id for r in entry.queries()["cluster_assign"](spark, SF).collect()}
    listed = {r.id: r for r in entry.queries()["cluster_and_list_text"](spark, SF).collect()}
    assert len(set(got.values())) <= len(set(plain.values())) and all(got[i] == r.cluster_id and r.source_count == list(got.values()).count(r.cluster_id) for i, r in listed.items())
