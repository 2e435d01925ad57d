"""Suffix-array dedup: every byte of a string of 100 bytes that also starts earlier goes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, whole_text
from .suffix_array import shared_prefixes, suffix_array

#: Length of the strings, of the anchors inside them, and the windows that share at most one anchor.
LENGTH, ANCHOR = 100, 36
SPAN = LENGTH - ANCHOR + 1
#: Bytes looked at together, and bytes of a suffix array's text.
PIECE, SHARD = 1 << 20, 3 << 20
#: Bytes by which the surroundings of anchors are told apart before they are sorted.
STEP = 16
#: An anchor with more different surroundings than this is told apart by what lies beside it as well.
HOT = 2000
#: A hot anchor's part with more entries than this goes window by window instead of into a suffix array.
WIDE = 5000
#: A key with more than one in HEAVY of all rows is dealt over SALTS tasks in joins.
HEAVY, SALTS = 250, 32
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000
_B = 0x100000001B3
_M = (1 << 64) - 1
LAST = (1 << 63) - 1


def grams(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each place."""
    h = a.astype(np.uint64)
    h += np.uint64(1)
    step, factor = 1, _B
    four = None
    while step * 2 <= 32:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = step * 2, factor * factor & _M
        if step == 4:
            four = h
    n = len(a) - ANCHOR + 1
    h = h[:n] * np.uint64(pow(_B, 4, 1 << 64)) + four[32 : 32 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(a: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their anchor, in texts side by side in a, the last byte before doc_ends: (first window, windows, place of the anchor, its hash).

    The anchor of a window is the gram with the smallest hash in it, the leftmost of equals, so that equal windows have equal anchors at the same
    place in them.
    """
    none = np.zeros(0, np.int64)
    if len(a) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h = grams(a)
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= SPAN:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    n = len(h) - SPAN + 1
    m = np.minimum(m[:n], m[SPAN - step : SPAN - step + n])
    place = (m & low).astype(np.int64)
    whole = np.ones(n, bool)
    for e in doc_ends.tolist():  # windows that end in the next text
        whole[max(e - LENGTH + 1, 0) : e] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    p = place[at]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return at[first], np.diff(np.r_[first, len(at)]), p[first], h[p[first]]


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Texts put together to pieces of a bounded size; a longer text in several that overlap by a window less a byte. (bytes, text numbers, starts in the texts, ends in the bytes)"""
    held: list[bytes] = []
    numbers: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for o in range(0, len(t) - LENGTH + 1, PIECE):
            part = t[o : o + PIECE + LENGTH - 1]
            held.append(part)
            numbers.append(k)
            starts.append(o)
            size += len(part)
            ends.append(size)
            if size >= PIECE:
                yield b"".join(held), numbers, starts, ends
                held, numbers, starts, ends, size = [], [], [], [], 0
    if held:
        yield b"".join(held), numbers, starts, ends


def anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            for buffer, _, _, ends in pieces([x or b"" for x in b.column(0).slice(at, 512).to_pylist()]):
                h, n = np.unique(anchors(np.frombuffer(buffer, np.uint8), np.asarray(ends))[3].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input d, tie, t. Where each run of windows starts (start), how many windows, and where the anchor is in them (run = 128 * windows + place)."""
    digest = xxhash.xxh3_64_intdigest
    names = ["h", "c", "d", "tie", "start", "run"]
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            d, tie = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            for buffer, numbers, starts, ends in pieces([x or b"" for x in part.column(2).to_pylist()]):
                s, n, p, h = anchors(np.frombuffer(buffer, np.uint8), np.asarray(ends))
                if not len(s):
                    continue
                view = memoryview(buffer)
                c = np.array([digest(view[i:j]) for i, j in zip(s.tolist(), (s + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
                of = np.searchsorted(np.asarray(ends), s, side="right")
                k = np.asarray(numbers)[of]
                begin = s - np.r_[0, ends[:-1]][of] + np.asarray(starts)[of]
                columns = [h.view(np.int64), c.view(np.int64), d[k], tie[k], begin.astype(np.int32), (n * 128 + p - s).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def not_first(texts: list[bytes], windows: np.ndarray, d: np.ndarray, tie: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each text, its windows that another text has as well and earlier. One suffix array over all texts of the shard."""
    lengths = np.array([len(t) for t in texts], np.int64)
    # 0 ends the whole, 1 each text
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + 2
    begins = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    s[begins + lengths] = 1
    s = np.r_[s, np.int32(0)]
    sa = suffix_array(s, 258)
    plcp = shared_prefixes(s, sa, begins, windows, 1, LENGTH)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    offset = np.arange(len(owner)) - begins[owner]
    is_window = np.r_[offset < windows[owner], False]
    sa = sa[is_window[sa]]
    joined = plcp[sa] >= LENGTH
    # a run of suffixes that share the whole string is one string's places
    run = np.cumsum(~joined)
    many = np.bincount(run)[run] > 1
    sa, run = sa[many], run[many]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    if not len(sa):
        return out
    o = owner[sa]
    place = start[o] + offset[sa]
    order = np.lexsort((place, tie[o], d[o], run))
    first = np.maximum.accumulate(np.where(np.r_[True, np.diff(run[order]) != 0], np.arange(len(order)), 0))
    # rows alike are one document: the same place twice is the first twice
    own = np.column_stack([d[o], tie[o], place])[order]
    gone = sa[order[(own != own[first]).any(1)]]
    if not len(gone):
        return out
    by = np.sort(gone)
    k = owner[by]
    for i, rows in zip(np.unique(k), np.split(by, np.flatnonzero(np.diff(k)) + 1), strict=True):
        out[i] = rows - begins[i]
    return out


def spans_of(windows: np.ndarray) -> list[int]:
    """Runs of consecutive windows as first, number, first, number ..."""
    if not len(windows):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(windows) != 1])
    return np.column_stack([windows[first], np.diff(np.r_[first, len(windows)])]).ravel().tolist()


def narrowed(group: list[tuple]) -> Iterator[tuple]:
    """Entries (h, c, lo, n, d, tie, start, t, q) of one group, less the windows at their ends that no other entry can have, and less q.

    A window with l bytes before the anchor, which stands at q, holds the STEP * (l // STEP) bytes before it and as many after it as any window with such an l. No two entries
    are the same, so where these bytes are those of one entry only, its windows of that kind are first and alone.
    """
    kinds = (LENGTH - ANCHOR) // STEP
    most = LENGTH - ANCHOR
    met: dict[tuple[int, bytes], int] = {}
    found = []
    for h, c, lo, n, d, tie, start, t, q in group:
        own = []
        for k in range(kinds):
            first, last = max(q - (STEP * (k + 1) - 1 if k < kinds - 1 else most), 0), min(q - STEP * k, n - 1)
            if first <= last:
                key = k, t[q - STEP * k : q + LENGTH - STEP - STEP * k]
                met[key] = met.get(key, 0) + 1
                own.append((key, first, last))
        found.append(((h, c, lo, d, tie, start, t), own))
    for (h, c, lo, d, tie, start, t), own in found:
        open_ = [(first, last) for key, first, last in own if met[key] > 1]
        if open_:
            i, j = min(x[0] for x in open_), max(x[1] for x in open_)
            yield h, c, lo + i, j - i + 1, d, tie, start + i, t[i : j + LENGTH]


def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input g, h, c, lo, n, d, tie, start, t, q, those of one g together: suffix arrays over shards of whole groups. Output h, c, lo and spans of windows that start earlier elsewhere."""
    held: list[tuple] = []
    group: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        h, c, lo, n, d, tie, start, t = zip(*held, strict=True)
        found = not_first(list(t), np.array(n, np.int64), np.array(d, np.int64), np.array(tie, np.int64), np.array(start, np.int64))
        rows = [(a, b, x, spans_of(w + x)) for a, b, x, w in zip(h, c, lo, found, strict=True) if len(w)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["h", "c", "lo", "spans"])

    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if row[0] != last:
                for entry in narrowed(group):
                    held.append(entry)
                    size += len(entry[-1])
                group = []
                if size >= SHARD:
                    yield flush()
                    held, size = [], 0
            last = row[0]
            group.append(row[1:])
    held += narrowed(group)
    if held:
        yield flush()


def later_windows(wide: DataFrame) -> DataFrame:
    """Of entries as they are dealt, the windows that start earlier in another: h, c and spans. No step holds a group, whatever its size: counts by hash and the
    first places are pre-aggregated, and windows are told apart by their bytes."""
    each = wide.select("h", "c", "d", "tie", "lo", "start", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    each = each.select("h", "c", F.struct("d", "tie", (F.col("start") + F.col("k")).alias("start")).alias("at"), (F.col("lo") + F.col("k")).alias("lo"), F.substring(F.col("t"), F.col("k") + 1, F.lit(LENGTH)).alias("w"))
    each = each.withColumn("x", F.xxhash64("w"))
    again = stored(each.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x"), "repeated-windows")
    each = each.join(bounded_broadcast(again), "x")
    first = stored(each.groupBy("w").agg(F.min("at").alias("first")), "first-windows")
    return each.join(bounded_broadcast(first), "w").filter("at <> first").select("h", "c", F.array(F.col("lo").cast("int"), F.lit(1)).alias("spans"))


def removed_spans(marks: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from (first window, windows) pairs, flat."""
    if not marks:
        return []
    m = np.asarray(marks, np.int64).reshape(-1, 2)
    m = m[np.argsort(m[:, 0], kind="stable")]
    end = np.maximum.accumulate(m[:, 0] + m[:, 1] - 1 + LENGTH)
    first = np.flatnonzero(np.r_[True, m[1:, 0] > end[:-1]])
    return list(zip(m[first, 0].tolist(), np.minimum(end[np.r_[first[1:] - 1, len(m) - 1]], length).tolist(), strict=True))


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hot_keys(counts: DataFrame, key: str) -> list[int]:
    """The keys with more than one in HEAVY of all rows, by counts (key, n): fewer than HEAVY, whatever the input."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.filter(F.col("n") > max(total // HEAVY, SALTS)).select(key).collect()]


def salt_of(key: str, hot: list[int]) -> Column:
    """Which of the copies of a key's row on the other side a row meets: one of SALTS where the key is hot."""
    return F.when(F.col(key).isin(hot), F.pmod(F.xxhash64("d", "tie", "start"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))


def salts_of(key: str, hot: list[int]) -> Column:
    """A row for each salt where the key is hot, else one."""
    return F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))


def salted(left: DataFrame, right: DataFrame, on: list[str], key: str, hot: list[int]) -> DataFrame:
    """left joined with right, which has a row for each key: those of hot keys meet copies of it in several tasks."""
    if not hot:
        return left.join(right, on)
    return left.withColumn("salt", salt_of(key, hot)).join(right.withColumn("salt", salts_of(key, hot)), [*on, "salt"]).drop("salt")


def marks(docs: DataFrame, others: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, found): base has d, tie and the text's bytes t of every row of docs (and other columns in rest), found for each (d, tie) the windows that start earlier elsewhere, as flat pairs.

    tie is -1 where an earlier document has the same whole text. The steps:

    1. Equal whole texts are represented by their first one; the others go wholly, and of rows alike one is looked at. Only the rows that are copies or share a doc_id are
       told apart by a table, the rest is not touched.
    2. Every window of 100 bytes has an anchor, its gram of 36 bytes with the smallest hash. Windows can only be equal if their anchors are, so runs of windows whose
       anchor occurs once are out; anchors are counted with pre-aggregation before the shuffle.
    3. Runs under one anchor with the same bytes are made one, its first place kept.
    4. Where an anchor has different runs, their bytes are fetched and dealt by anchor into shards; each shard's suffix array, sorted by induction,
       and its permuted common prefixes give the windows that different runs share, and which of them isn't the first. Windows whose inner bytes no other run of their anchor has are left out before. An anchor alone in its surroundings is a shard's list
       of one and needs no sorting. Under a very frequent anchor runs are dealt by the 32 bytes on either side of it as well: every
       window has 32 bytes on one of the sides. What is still wide then, as under a passage that every document follows with words of its own, is taken apart into its
       windows, whose first places are minima by their bytes.
    5. A window goes if its run isn't the first of its bytes, or if the suffix array says so.

    So equality of whole texts (SHA-256) and of whole runs (64 bits beside the 64 of their anchor) is decided by hash, what different runs share by the suffix
    array. A document is told by its id and tie, which sets rows without an id apart by their texts. An anchor or a run that many rows have is dealt over several tasks in the joins.
    """
    text = whole_text().cast("binary")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    keys = docs.select(d.alias("d"), F.unhex(F.sha2(text, 256)).alias("sha"))
    twice = stored(keys.groupBy("sha").agg(F.count("*").alias("n"), F.min("d").alias("least")).filter("n > 1").select("sha", "least"), "repeated-texts")
    repeated = keys.join(bounded_broadcast(twice), "sha")
    copies = repeated.filter("d <> least").select("d", "sha", F.lit(-1).cast("long").alias("odd"), F.lit(False).alias("alike"))
    # rows with one id and text, which are one document
    alike = repeated.filter("d = least").groupBy("d", "sha").agg(F.count("*").alias("n")).filter("n > 1").select("d", "sha", F.lit(None).cast("long").alias("odd"), F.lit(True).alias("alike"))
    # different texts under one id: ordered by a part of their hash
    torn = keys.groupBy("d").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b").select("d")
    prefix = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    ties = keys.join(torn, "d").select("d", "sha", prefix.alias("odd"), F.lit(False).alias("alike"))
    odd = stored(copies.unionAll(ties).unionAll(alike).groupBy("d", "sha").agg(F.min("odd").alias("odd"), F.max("alike").alias("alike")), "odd-texts")
    sha = F.unhex(F.sha2(F.col("t"), 256))
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []
    base = docs.select(d.alias("d"), text.alias("t"), *rest)
    told = bounded_broadcast(odd.withColumnsRenamed({"d": "_d", "sha": "_sha"}))
    base = base.join(told, (F.col("d") == F.col("_d")) & (sha == F.col("_sha")), "left").select("d", F.coalesce("odd", F.lit(0)).cast("long").alias("tie"), "t", F.coalesce("alike", F.lit(False)).alias("alike"), *["rest"][: len(rest)])
    own = base.filter("tie >= 0")
    if odd.filter("alike").limit(1).count():
        # one row for each document; what it finds is joined to all its rows at the end
        own = own.filter("not alike").select("d", "tie", "t").unionAll(own.filter("alike").groupBy("d", "tie").agg(F.first("t").alias("t")))
    often = stored(own.select("t").mapInArrow(anchor_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "repeated-anchors")
    hot = hot_keys(often, "h")
    runs = own.select("d", "tie", "t").mapInArrow(anchor_rows, "h long, c long, d long, tie long, start int, run int")
    runs = stored(salted(runs, often.select("h"), ["h"], "h", hot), "repeated-runs")
    first = runs.groupBy("h", "c").agg(F.min(F.struct("d", "tie", "start")).alias("f"), F.first("run").alias("run"), F.count("*").alias("n"))
    first = stored(first.select("h", "c", "f.*", "run", "n"), "first-runs")
    several = stored(first.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "several-runs")
    hot = several.filter(F.col("m") > HOT).limit(1).count() > 0
    wanted = first.join(several, "h")
    entry = F.struct("h", "c", "start", "run", "m")
    lists = wanted.groupBy("d", "tie").agg(F.collect_list(entry).alias("wanted"))  # no more than a document has windows
    fetched = own.join(lists, ["d", "tie"]).select("d", "tie", "t", F.explode("wanted").alias("w"))
    windows, place = F.shiftright(F.col("w.run"), 7), F.col("w.run").bitwiseAND(127)
    fetched = fetched.select("w.h", "w.c", "w.m", "d", "tie", F.col("w.start").alias("start"), windows.alias("windows"), place.alias("place"), F.substring(F.col("t"), F.col("w.start") + 1, windows + LENGTH - 1).alias("t"))
    half = (LENGTH - ANCHOR) // 2
    middle = F.least(F.greatest(F.col("place") - half, F.lit(0)), F.col("windows"))
    left_key, right_key = F.xxhash64("h", F.substring(F.col("t"), F.col("place") - half, F.lit(half + 1))), F.xxhash64("h", F.substring(F.col("t"), F.col("place") + ANCHOR + 1, F.lit(half)))
    part = lambda g, lo, n: F.struct(g.alias("g"), lo.cast("int").alias("lo"), n.cast("int").alias("n"))
    parts = F.when(F.col("m") <= HOT, F.array(part(F.col("h"), F.lit(0), F.col("windows")))).otherwise(F.array(part(left_key, F.lit(0), middle), part(right_key, middle, F.col("windows") - middle)))
    dealt = fetched.withColumn("p", F.explode(parts)).filter("p.n > 0")
    columns = ["g", "h", "c", "lo", "n", "d", "tie", "start", "t", "q"]
    dealt = dealt.select("p.g", "h", "c", "p.lo", "p.n", "d", "tie", (F.col("start") + F.col("p.lo")).alias("start"), F.substring(F.col("t"), F.col("p.lo") + 1, F.col("p.n") + LENGTH - 1).alias("t"), (F.col("place") - F.col("p.lo")).alias("q"), (F.col("m") > HOT).alias("hot"))
    later = None
    if hot:
        dealt = stored(dealt, "dealt-runs")
        wide = stored(dealt.filter("hot").groupBy("g").agg(F.count("*").alias("entries")).filter(F.col("entries") > WIDE).select("g"), "wide-groups")
        if wide.limit(1).count():
            wide = bounded_broadcast(wide)
            later = later_windows(dealt.filter("hot").join(wide, "g", "left_semi"))
            dealt = dealt.join(wide, "g", "left_anti")
    dealt = dealt.select(*columns)
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parallel, "g").sortWithinPartitions("g").mapInArrow(sort_shards, "h long, c long, lo int, spans array<int>")
    marked = sorted_.select("h", "c", "spans")
    told = (marked if later is None else marked.unionAll(later)).groupBy("h", "c").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    hot = hot_keys(first, "c")
    decided = first.select(F.col("h"), F.col("c"), F.col("d").alias("fd"), F.col("tie").alias("ftie"), F.col("start").alias("fstart")).join(told, ["h", "c"], "left")
    every = salted(runs, decided, ["h", "c"], "c", hot)
    is_first = (F.col("d") == F.col("fd")) & (F.col("tie") == F.col("ftie")) & (F.col("start") == F.col("fstart"))
    spans = F.when(~is_first, F.array(F.lit(0), F.shiftright("run", 7))).otherwise(F.coalesce("spans", F.array().cast("array<int>")))
    hit = every.select("d", "tie", "start", spans.alias("spans")).filter(F.size("spans") > 0)
    flat = F.transform("spans", lambda x, i: F.when(i % 2 == 0, x + F.col("start")).otherwise(x))
    found = hit.groupBy("d", "tie").agg(F.flatten(F.collect_list(flat)).alias("marks"))
    return base, found


def dedup(docs: DataFrame, text: str = "clean") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and the bytes that stay, of every row of docs.

    Texts are whole, as UTF-8 bytes, a null one empty; matches stay within a document and are judged on the input. Documents are in the order of doc_id, null last;
    different texts under one doc_id in that of their hash; rows alike are the same document and come out alike. An empty table gives no rows. `text` names
    the column of the remaining bytes, which may begin or end inside a character; None leaves it out.
    """
    schema = T.StructType([T.StructField("d", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if text:
        schema = schema.add(text, T.BinaryType())

    def one(t: bytes, spans: list[tuple[int, int]]) -> tuple:
        kept = cut_text(t, spans)
        return (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)[: len(schema) - 1]

    base, found = marks(docs)
    out = base.join(found, ["d", "tie"], "left").select("d", "tie", "t", "marks").mapInArrow(per_document(one, schema.names, [pa.int64()] * 3 + [pa.string(), pa.binary()][: len(schema) - 4]), schema)
    return out.select(F.when(F.col("d") == LAST, F.lit(None)).otherwise(F.col("d")).cast("long").alias("doc_id"), *schema.names[1:])


def per_document(one: Callable[[bytes, list[tuple[int, int]]], tuple], names: list[str], kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: what `one` makes of the text and its removed spans, after the columns but the last three, which are tie, t and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = []
                for tie, t, m in zip(*(part.column(k).to_pylist() for k in range(b.num_columns - 3, b.num_columns)), strict=True):
                    if tie < 0:
                        spans = [(0, len(t))] if len(t) >= LENGTH else []
                    else:
                        spans = removed_spans(m, len(t))
                    made.append(one(t, spans))
                front = [part.column(k) for k in range(b.num_columns - 3)]
                back = [pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*front, *back], names)

    return run


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with what stays of their texts; characters that lost some of their bytes go as a whole, a null text becomes empty. All rows stay."""
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("text", T.StringType())])
    base, found = marks(docs, others)
    # columns go by their place, so that no name of theirs meets one of these
    out = base.join(found, ["d", "tie"], "left").select(*[F.col(f"rest.`{c}`").alias(f"_c{k}") for k, c in enumerate(others)], "tie", "t", "marks")
    return out.mapInArrow(per_document(lambda t, spans: (cut_text(t, spans).decode(errors="ignore"),), schema.names, [pa.string()]), schema)
