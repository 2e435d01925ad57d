"""Repair of conversations: the cheapest edits after which roles take turns, found by bucket-queue shortest paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain as chain_of

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, stored, whole_text

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What has been said: nothing, a system line, a user's, an assistant's. A conversation may end after nothing and after the assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: From which states a line with this initial can be kept, and where it leads.
KEEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (0, None, None, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A segment of a conversation ends after so many lines or characters.
SEGMENT_ROWS, SEGMENT_CHARS = 1_000, 1_000_000
INITIALS = "sua?"

SEGMENT = (
    "conv_id {id}, part int, seg int, lines string, times array<long>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows as a crc of conv_id and turn damages them; null roles and texts are one space.

    0 drops the row, 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes the user say it; of 20 values.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(kind == 4, "user").otherwise(name("role"))
    return conversations.filter(kind != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def is_blank(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(SPACE_CHARS))) == 0


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of each distinct row, with blank, first (nobody said it before in that role) and truncated.

    Rows alike are counted before anything is dealt out. What came first is an aggregate joined on the whole key, which no two rows share.
    """
    n = F.col("copies") if "copies" in rows.columns else F.lit(1)
    each = rows.groupBy("conv_id", F.col("turn").cast("long").alias("turn"), whole_text("role").alias("role"), whole_text().alias("text")).agg(F.sum(n).cast("long").alias("copies"))
    end = F.substring(F.rtrim("text", F.lit(SPACE_CHARS)), -1, 1)
    told = each.select("*", is_blank(F.col("text")).alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"), F.sha2("text", 256).alias("digest"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = told.filter("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(at)["turn"].alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return told.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", "blank", (F.col("d").isNotNull()).alias("first"), "truncated")


def segments(found: DataFrame, rows: int = SEGMENT_ROWS, chars: int = SEGMENT_CHARS) -> DataFrame:
    """Lines of each conversation in the order of turn (nulls first), role and text, cut into segments: a part is a range of the whole order, so a long conversation is many tasks'.

    lines has a character for each line that isn't deleted for sure: its role's initial, in upper case if it is truncated, and `x` for lines that are; times says how many.
    """
    schema = SEGMENT.format(id=found.schema["conv_id"].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, now, size = TaskContext.get().partitionId(), 0, None, 0
        done: list[list] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
            for conv, turn, role, text, copies, blank, first, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now[0] or len(now[3]) >= rows or size >= chars:
                    if now is not None:
                        done.append(now)
                        if len(done) >= 256:
                            yield out()
                    now, size, seg = [conv, part, seg, "", [], [], [], 0, 0, 0, 0, "", "", None, None, 0], 0, seg + 1
                initial, size = role[:1], size + len(text) + len(role)
                kept = first and not blank
                if kept:
                    known = initial if initial in "sua" and initial else "?"
                    now[3] += known.upper() if cut and known != "?" else "!" if cut else known
                    now[4].append(1)
                    now[5].append(role)
                    now[6].append(text)
                    now[9] += cut
                if gone := copies - kept:
                    now[3] += "x"
                    now[4].append(gone)
                    now[5].append(None)
                    now[6].append(None)
                    now[7 if blank else 8] += gone
                now[10] += (now[12] + initial not in ("su", "ua", "au") if len(now[4]) > (kept + bool(gone)) else 0) + (copies - 1)
                now[11], now[12] = (initial if len(now[4]) == kept + bool(gone) else now[11]), initial
                if turn is not None:
                    now[15] += turn != now[14]
                    now[13], now[14] = turn if now[13] is None else now[13], turn
        if now is not None:
            done.append(now)
            yield out()

    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    turn = F.col("turn").asc_nulls_first()
    said = F.left(F.concat(F.left("role", F.lit(64)), F.lit("\0"), F.left("text", F.lit(64))), F.lit(64))  # ranges are drawn from samples that the driver sees, so their keys are short
    return found.repartitionByRange(parts, "conv_id", turn, said).sortWithinPartitions("conv_id", turn, "role", "text").mapInArrow(run, schema)


def arcs(line: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a line that may stay, by the edit's letter."""
    more = TRUNCATED if line.isupper() or line == "!" else 0
    out = [("D", DELETE, state)]
    if (to := KEEPS.get(line.lower(), {}).get(state)) is not None:
        out.append(("K", more, to))
    return [*out, ("R", REROLE + more, NEXT[state])]


#: What leads to a state, by line: (state before, cost).
BACK = {line: [[(s, c) for s in range(4) for _, c, to in arcs(line, s) if to == t] for t in range(4)] for line in "suaSUA?!"}
BACK_INSERT = [[s for s in range(4) if NEXT[s] == t] for t in range(4)]


def distances(lines: str, ends: list[int | None] | tuple) -> list[list[int | None]]:
    """Least cost to the end from before each line (and after the last) in each state; ends are the costs after the last.

    Dial's queue: costs are small integers, so places wait in a bucket for each distance and buckets are emptied in order; the first distance of a place is its least.
    """
    n, least = len(lines), min(e for e in ends if e is not None)
    found: list[list[int | None]] = [[None] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = [[]]

    def put(d: int, i: int, s: int) -> None:
        if found[i][s] is None:
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append((i, s))

    for s, e in enumerate(ends):
        if e is not None:
            put(e - least, n, s)
    d = 0
    while d < len(buckets):
        bucket = buckets[d]
        for i, s in bucket:  # grows while edits without cost lead to it
            if found[i][s] is not None:
                continue
            found[i][s] = d + least
            for before in BACK_INSERT[s]:
                put(d + INSERT, i, before)
            if i:
                for before, cost in BACK[lines[i - 1]][s]:
                    put(d + cost, i - 1, before)
        buckets[d] = []
        d += 1
    return found


def walk(lines: str, found: list[list[int | None]], ends: list[int | None] | tuple, state: int) -> tuple[str, int]:
    """The least letters of all cheapest ways from a state before the lines, and the state after them: at each place the first letter whose arc is tight.

    After the last line it stops as soon as it may: what a next segment can still insert is decided there.
    """
    out, i = [], 0
    while True:
        d = found[i][state]
        if i == len(lines):
            if d == ends[state]:
                return "".join(out), state
            options = []
        else:
            options = arcs(lines[i], state)
        for letter, cost, to in sorted([*((x, c, (i + 1, t)) for x, c, t in options), ("I", INSERT, (i, NEXT[state]))]):
            rest = found[to[0]][to[1]]
            if rest is not None and d == cost + rest:
                out.append(letter)
                i, state = to
                break
        else:
            raise AssertionError("no tight arc")


def edits(lines: str, times: list[int], roles: list[str | None], texts: list[str | None], ends: list[int | None] | tuple, state: int) -> tuple[str, int, list[tuple[str, str]], int]:
    """(audit, cost, repaired (role, text), state after) of a segment. Lines that go for sure are left out of the search and go where they are met."""
    free = lines.replace("x", "")
    letters, after = walk(free, distances(free, ends), ends, state)
    audit, cost, rows, k = [], 0, [], 0

    def gone() -> None:
        nonlocal k, cost
        while k < len(lines) and lines[k] == "x":
            audit.append("D" * times[k])
            cost += DELETE * times[k]
            k += 1

    gone()
    for letter in letters:
        audit.append(letter)
        if letter == "I":
            state, cost = NEXT[state], cost + INSERT
            rows.append((NAMES[state], ""))
            continue
        to, spent = next((t, c) for x, c, t in arcs(lines[k], state) if x == letter)
        if letter != "D":
            rows.append((roles[k] if letter == "K" else NAMES[to], texts[k]))
        state, cost, k = to, cost + spent, k + 1
        gone()
    return "".join(audit), cost, rows, after


def chain(left: list, right: list) -> list:
    """Least costs through two segments, each 4 x 4 from state to state."""
    out = []
    for s in range(4):
        for t in range(4):
            ways = [left[4 * s + m] + right[4 * m + t] for m in range(4) if left[4 * s + m] >= 0 and right[4 * m + t] >= 0]
            out.append(min(ways, default=-1))
    return out


def before(costs: list, ends: list[int | None]) -> list[int | None]:
    """Costs to the end from before a segment, from those after it."""
    return [min((costs[4 * s + t] + ends[t] for t in range(4) if costs[4 * s + t] >= 0 and ends[t] is not None), default=None) for s in range(4)]


def long_plans(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seg, state, ends) of the segments of conversations that have several: where each is entered, and what the rest costs after it.

    Costs through a segment compose as matrices, its walk as a map of states. Segments are put together by part and parts by conversation, up and down again, first for
    the costs and then for the walks; so no task holds more of a conversation than a part's segments, or a row for each part.
    """
    spark_id = pieces.schema["conv_id"].dataType.simpleString()
    many = pieces.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).filter("n > 1")
    key = ["conv_id", "part"]
    free = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select(*key, "seg", F.regexp_replace("lines", "x", "").alias("lines"))

    def matrix(lines: str) -> list[int]:
        out = [-1] * 16
        for t in range(4):
            first = distances(lines, [0 if s == t else None for s in range(4)])[0]
            for s in range(4):
                out[4 * s + t] = -1 if first[s] is None else first[s]
        return out

    @F.pandas_udf("array<int>")
    def matrices(lines: pd.Series) -> pd.Series:
        return lines.map(matrix)

    def total(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seg")
        m = list(df["m"].iloc[0])
        for x in df["m"].iloc[1:]:
            m = chain(m, list(x))
        return df[key].head(1).assign(m=[m])

    def ends_from(df: pd.DataFrame, by: str, last: list[int | None]) -> pd.DataFrame:
        df = df.sort_values(by)
        out, ends = [], last
        for m in df["m"].iloc[::-1]:
            least = min(e for e in ends if e is not None)  # only differences matter
            out.append([-1 if e is None else e - least for e in ends])
            ends = before(list(m), ends)
        return df.assign(ends=out[::-1])

    def ends_of_parts(df: pd.DataFrame) -> pd.DataFrame:
        return ends_from(df, "part", list(ENDS))[[*key, "ends"]]

    def ends_of_segments(df: pd.DataFrame) -> pd.DataFrame:
        return ends_from(df, "seg", [None if e < 0 else int(e) for e in df["last"].iloc[0]])[[*key, "seg", "ends"]]

    @F.pandas_udf("array<int>")
    def walks(lines: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for x, e in zip(lines, ends, strict=True):
            e = [None if v < 0 else int(v) for v in e]
            found = distances(x, e)
            out.append([walk(x, found, e, s)[1] if found[0][s] is not None else -1 for s in range(4)])
        return pd.Series(out)

    def whole_map(df: pd.DataFrame) -> pd.DataFrame:
        state = list(range(4))
        for w in df.sort_values("seg")["w"]:
            state = [int(w[s]) if s >= 0 else -1 for s in state]
        return df[key].head(1).assign(w=[state])

    def entered(df: pd.DataFrame, by: str, state: int) -> pd.DataFrame:
        df, out = df.sort_values(by), []
        for w in df["w"]:
            out.append(state)
            state = int(w[state])
        return df.assign(state=out)

    def states_of_parts(df: pd.DataFrame) -> pd.DataFrame:
        return entered(df, "part", NOTHING)[[*key, "state"]]

    def states_of_segments(df: pd.DataFrame) -> pd.DataFrame:
        return entered(df, "seg", int(df["enter"].iloc[0]))[[*key, "seg", "state", "ends"]]

    named = lambda rest: f"conv_id {spark_id}, part int, {rest}"
    def beside(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        other = right.select(F.col("conv_id").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("part", *more)], *[c for c in right.columns if c not in ("conv_id", "part", *more)])
        same = F.col("conv_id").eqNullSafe(F.col("_c"))
        for c in ("part", *more):
            same = same & (F.col(c) == F.col(f"_{c}"))
        return left.join(other, same).drop("_c", *[f"_{c}" for c in ("part", *more)])

    costs = free.select("*", matrices("lines").alias("m"))
    parts = costs.groupBy(*key).applyInPandas(total, named("m array<int>"))
    after = parts.groupBy("conv_id").applyInPandas(ends_of_parts, named("ends array<int>")).withColumnRenamed("ends", "last")
    ends = beside(costs.select(*key, "seg", "m"), after).groupBy(*key).applyInPandas(ends_of_segments, named("seg int, ends array<int>"))
    walked = stored(beside(free, ends, "seg").select(*key, "seg", "ends", walks("lines", "ends").alias("w")), "walks")
    maps = walked.groupBy(*key).applyInPandas(whole_map, named("w array<int>"))
    states = maps.groupBy("conv_id").applyInPandas(states_of_parts, named("state int")).withColumnRenamed("state", "enter")
    return beside(walked, states).groupBy(*key).applyInPandas(states_of_segments, named("seg int, state int, ends array<int>"))


REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id {id}, part int, seg int, place int, role string, text string"


def planned(pieces: DataFrame) -> DataFrame:
    """Segments with state and ends where a plan says them, each plan beside its segment in the order of the conversations."""
    plans = long_plans(pieces)
    fields = [f for f in pieces.schema.fields if f.name not in ("conv_id", "part", "seg")]
    plan = plans.select("conv_id", "part", "seg", F.lit(0).alias("kind"), "state", "ends", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    own = pieces.select("conv_id", "part", "seg", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("array<int>").alias("ends"), *[f.name for f in fields])
    both = plan.unionByName(own)
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seg", "kind")


def repaired_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(segment, audit, cost, repaired rows), one after another; a segment without a plan is a whole conversation."""
    plan = None
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            for r in batch.slice(at, 16).to_pylist():
                if r["kind"] == 0:
                    plan = r["state"], [None if e < 0 else e for e in r["ends"]]
                    continue
                state, ends = plan or (NOTHING, ENDS)
                plan = None
                audit, cost, rows, _ = edits(r["lines"], r["times"], r["roles"], r["texts"], ends, state)
                yield r, audit, cost, rows


def report(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text and, where rows stand for several alike, copies): its gaps, faults, the least cost of repair, the edits and a digest of what it is then.

    Lines are taken by turn, nulls first, then role and text; null roles and texts are empty. A line's first fault counts: blank (only ASCII white space), duplicate (role and text came before in the conversation),
    truncated (what it ends in isn't one of `.!?`). Edits keep a line (0), give it to the user or assistant (3), delete it (4; always if blank or duplicate), or insert an empty line of either (3); a truncated line that stays costs
    3 more. After them the initials of the roles read `(s?(ua)+)?`; of the cheapest, the edits with the least letters are taken. illegal counts neighbours whose roles don't follow one another as they are. A null conv_id is a
    conversation; a role without an initial can't be kept. An empty table gives no rows.

    The digest is one chain over a conversation's bytes, so one task reads the repaired text of a conversation, in segments; everything else about it is shared out.
    """
    pieces = stored(segments(faults(rows), segment_rows, segment_chars), "segments")
    schema = REPORT.format(id=rows.schema["conv_id"].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, kinds = None, None

        def closed() -> tuple:
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            return (now["conv_id"], gaps, *(now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(now["audit"]), now["hash"].hexdigest())

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for b in batches:
                kinds = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield b

        for r, audit, cost, lines in repaired_segments(seen(batches)):
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    done.append(closed())
                    if len(done) >= 1_000:
                        yield out()
                now = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "rows": 0, "last": None, "low": None, "high": None, "turns": 0}
            elif now["last"] + r["first"] not in ("su", "ua", "au"):
                now["illegal"] += 1
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += r[c]
            now["turns"] += r["turns"] - (r["turns"] > 0 and r["low"] == now["high"])
            now["low"] = r["low"] if now["low"] is None else now["low"]
            now["high"] = now["high"] if r["high"] is None else r["high"]
            now["last"] = r["last"]
            now["cost"] += cost
            now["audit"].append(audit)
            for role, text in lines:
                now["hash"].update(("\n" * (now["rows"] > 0) + role + ":" + text).encode())
                now["rows"] += 1
        if now is not None:
            done.append(closed())
            yield out()

    return planned(pieces).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, part, seg, place, role, text of the repaired conversations, in that order; those that nothing is left of have no rows."""
    pieces = stored(segments(faults(rows), segment_rows, segment_chars), "segments")
    schema = TURNS.format(id=rows.schema["conv_id"].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            # a batch can end between a plan and its segment, so one reader goes through all batches
            for r, _, _, lines in repaired_segments(chain_of([batch], batches)):
                told = [(r["conv_id"], r["part"], r["seg"], k, role, text) for k, (role, text) in enumerate(lines)]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True), kinds, strict=True)], names)

    return planned(pieces).mapInArrow(run, schema)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report of the damaged conversations, with every conversation of the table: those without rows have zeros, no edits and the digest of nothing."""
    all_ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    found = report(damaged(conversations))
    joined = all_ids.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
