import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def plainly(rows, chars=40, docs=5):
    """(doc_id, text) -> (text left, lines, dropped), line by line."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= chars and len(held[key(x)]) >= docs and d != max(held[key(x)], key=lambda v: (v is not None, v))  # noqa: E731, B023
        left = [x for x in lines if not gone(x)]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def lined():
    """Lines around both limits, in many spellings, at all places; rows alike, ids shared and missing, empty lines, a long text."""
    rng = random.Random(3)
    pool = [f"{'Ä' if k % 3 else 'É'} line {k} " + "ab C" * rng.randint(5, 14) for k in range(25)] + ["x" * 39, "x" * 40, "short", "", "  ", "y" * 38 + " \x0b\t", "\xa0" + "z" * 39]
    rows = []
    for k in range(160):
        lines = [rng.choice(["", "\t", " \r"]) + (rng.choice([str.upper, str, str])(x) if x.isascii() else x) + rng.choice(["", " ", "\r"]) for x in rng.choices(pool, k=rng.randint(1, 9))]
        rows.append((rng.choice([None, k, k, k // 2]), "\n".join(lines)))
    return [*rows, rows[3], rows[3], (500, None), (501, ""), (502, "\n\n"), (503, "\n".join([pool[0], *["own" * 20 + str(k) for k in range(3000)], pool[0], pool[1]])), (None, None)]


def test_lines_are_those_of_a_plain_reading(spark, lined):
    df = spark.createDataFrame(lined, "doc_id long, text string").repartition(3)
    want = plainly(lined)
    assert run(df) == want and sum(r[3] for r in want) > 100
    assert run(df, least_chars=5, least_docs=2) == plainly(lined, 5, 2)


@pytest.mark.parametrize(("common", "least"), [(1, 1), (3, 1), (100, 1), (100_000, 1_000)])
def test_both_ways_to_a_verdict_give_the_same_lines(spark, lined, common, least):
    df = spark.createDataFrame(lined, "doc_id long, text string")
    keys = line_dedup.line_keys(df).cache()
    got = {(r.d, r.x): r.places for r in line_dedup.dropped_places(keys, common=common, least_common=least).collect()}
    want = {(r.d, r.x): r.places for r in line_dedup.dropped_places(keys).collect()}
    assert got == want and want


def test_other_columns_stay_and_an_empty_table_gives_none(spark, none):
    wide = spark.createDataFrame([(k, "a line that stands in all of these documents " + "x" * 9) for k in range(6)], "doc_id long, text string")
    names = "d x pos h g t line key last goes n_docs n_rows places _d _x _t _row _lines n_lines n_dropped".split()
    out = line_dedup.dedup_lines(wide.select("*", *[F.lit(f"own {n}").alias(n) for n in names])).collect()
    assert [r.n_dropped for r in sorted(out)] == [1, 1, 1, 1, 1, 0]
    assert all(r[n] == f"own {n}" for r in out for n in names if n not in ("n_lines", "n_dropped"))
    empty = line_dedup.dedup_lines(none)
    assert empty.count() == 0 and "n_dropped" in empty.columns


def test_no_python_runs(spark, docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan
