import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from emberloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, copies string, seg string"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plainly(rows):
    """conv -> the report, forward over all strings of edits that are best so far for each state, role by role."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, kinds = set(), []
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        # roles so far that matter: none, s, ...u, ...a
        step = {"": "su", "s": "u", "u": "a", "a": "u"}

        def insert(best):
            for _ in range(4):
                for state, (cost, audit, said) in list(best.items()):
                    role = "assistant" if state == "u" else "user"
                    new = (cost + 3, audit + "I", [*said, role + ":"])
                    if role[0] not in best or new[:2] < best[role[0]][:2]:
                        best[role[0]] = new
            return best

        best = insert({"": (0, "", [])})
        for (_, _, role, text), kind in zip(own, kinds, strict=True):
            new = {}

            def put(state, way):
                if state not in new or way[:2] < new[state][:2]:  # noqa: B023
                    new[state] = way  # noqa: B023

            for state, (cost, audit, said) in best.items():
                put(state, (cost + 4, audit + "D", said))
                if kind in ("blank", "duplicate"):
                    continue
                more = 3 * (kind == "truncated")
                if role[:1] and role[:1] in step[state]:
                    put(role[:1], (cost + more, audit + "K", [*said, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if other[0] in step[state]:
                        put(other[0], (cost + 3 + more, audit + "R", [*said, f"{other}:{text}"]))
            best = insert(new)
        cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
        assert LEGAL.fullmatch("".join(x[0] for x in said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def told(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).drop("copies")


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "cut off ", " \n", "", "Yes.\x0b", "ÄÖ.", "long " * 50, "\xa0"]
    rows = []
    for conv in [*range(150), None]:
        n = rng.choice([0, 1, 2, 3, 5, 9, 14])
        for t in range(n):
            role = rng.choice(["system", None, "", "tool", "s"]) if rng.random() < 0.2 else rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            text = None if rng.random() < 0.05 else rng.choice(texts) if rng.random() < 0.6 else f"said {conv} {t}" + rng.choice([".", ""])
            rows.append((conv, rng.choice([t, t, t, t // 2, None, t + 5]), role, text))
    return [*rows, *rows[:8], (900, None, None, None), (901, 7, "system", "Only this."), (902, -3, "assistant", "a."), (902, 4, "user", "b.")]


def test_the_report_is_that_of_a_plain_search(spark, talks):
    got, want = told(repair.repair_damaged(frame(spark, talks).repartition(3))), plainly(damage(talks))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in {r[0] for r in talks}}
    assert {x for r in got.values() for x in r[6]} == set("DIKR") and any(r == empty for r in got.values())


@pytest.mark.parametrize(("rows", "chars"), [(1, 10**6), (2, 10**6), (3, 30), (7, 10**6)])
def test_segments_put_together_give_the_same(spark, talks, rows, chars):
    plain = [(c, t, r or "", x or "") for c, t, r, x in talks]
    got = told(repair.report(frame(spark, talks), rows, chars))
    assert got == plainly(plain)


def test_a_very_long_conversation_meets_in_several_parts(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"said {t}.", f"said {t}", "again.", ""])) for t in range(2500)]
    rows += [(c, t, ["user", "assistant"][t % 2], "Hm.") for c in range(2, 6) for t in range(3)] + [(7, 0, "user", "copy")] * 3000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        pieces = repair.segments(repair.faults(frame(spark, rows)), 100)
        assert pieces.filter("conv_id = 1").select("part").distinct().count() > 3 and pieces.filter("conv_id = 7").count() == 1
        assert told(repair.report(frame(spark, rows), 100)) == plainly(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repaired_turns_are_those_of_the_digest(spark, talks):
    df = frame(spark, talks)
    said = {}
    for r in repair.repaired_turns(df, 2).orderBy("part", "seg", "place").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, r in told(repair.report(df)).items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == r[7]


def test_bucket_queue_gives_least_distances():
    rng = random.Random(2)
    for _ in range(200):
        lines = "".join(rng.choices("suaSUA?!", k=rng.randint(0, 9)))
        ends = [rng.choice([None, 0, 3, 7]) for _ in range(3)] + [rng.randint(0, 4)]
        found = repair.distances(lines, ends)
        want = [[None if e is None else e for e in ends]]
        big = 10**9
        level = [big if e is None else e for e in ends]
        for k in range(len(lines), -1, -1):
            if k < len(lines):
                level = [min([c + after[to] for _, c, to in repair.arcs(lines[k], s)]) for s in range(4)]
            for _ in range(4):
                level = [min(level[s], 3 + level[repair.NEXT[s]]) for s in range(4)]
            after = level
            assert [min(x, big) if x < big else None for x in level] == found[k]
        assert want


def test_nothing_and_other_columns(spark):
    none = frame(spark, [])
    assert repair.repair_damaged(none).count() == 0 and repair.repaired_turns(none).count() == 0
    wide = frame(spark, [(1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes.")]).select("*", *[F.lit("own").alias(n) for n in ("c", "d", "first", "blank", "part", "lines", "audit", "kind", "state")])
    assert told(repair.report(wide))[1][5:7] == (0, "KK")


def test_the_sql_gives_the_report_too(spark, talks, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from emberloom.llm.oracles import ORACLES

    frame(spark, talks).write.parquet(str(tmp_path / "t"))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/t/*.parquet'")
    r = db.execute(ORACLES["op12_conversation_repair"])
    names = [d[0] for d in r.description]
    got = {x[0]: x[1:] for x in r.fetchall()}
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = plainly(damage(talks))
    assert {c: tuple(v) for c, v in got.items() if c in want} == want and len(got) == len({x[0] for x in talks})
