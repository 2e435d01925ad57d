"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: A merge candidate is skipped with this probability, drawn anew for every word of every document.
DROPOUT, SEED = 0.1, 17
#: Segmentations that a worker keeps. When there are more, all are forgotten and worked out anew if they come up.
KEPT = 400_000
#: Units up to this length are merged side by side, longer ones, and those with characters that have no piece, one by one; both draw the same skips.
SHORT, NEVER = 32, (1 << 32) - 1
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
FREE = -(1 << 40)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids; pairs gives for two ids, as one number, what they merge to: its rank, the best score first, and its id, as one number.

    raw gives what each id says, spelt the ids of the 256 bytes. tied finds where merges may come up that share their score, so that such a number alone doesn't
    say which is first.
    """

    ids: dict[str, int]
    pairs: dict[int, int]
    raw: tuple[bytes, ...]
    spelt: tuple[int, ...]
    characters: np.ndarray
    slots: np.ndarray
    values: np.ndarray
    tied: re.Pattern

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """pairs for arrays of ids, NEVER without one: a table by hash, the next slots for what collides."""
        key = a.astype(np.int64) << 16 | b  # negative if one of them is
        at = slot_of(key)
        found = np.full(key.shape, NEVER, np.uint32)
        hit = self.slots[at] == key
        found[hit] = self.values[at[hit]]
        open_ = np.nonzero(~hit & (self.slots[at] >= 0))
        while len(open_[0]):
            k = key[open_]
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            s = self.slots[at[open_]]
            good = s == k
            which = tuple(x[good] for x in open_)
            found[which] = self.values[at[which]]
            more = ~good & (s >= 0)
            open_ = tuple(x[more] for x in open_)
        return found


def slot_of(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slots_of(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """pairs as a hash table with open addressing."""
    slots, values = np.full(SLOTS, FREE, np.int64), np.zeros(SLOTS, np.uint32)
    keys, left = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.uint32, len(pairs))
    at = slot_of(keys)
    while len(keys):
        # of the keys at a free slot one takes it, the others go on
        free = slots[at] < 0
        slots[at[free]] = keys[free]
        won = slots[at] == keys
        values[at[won]] = left[won]
        keys, left, at = keys[~won], left[~won], (at[~won] + 1) & (SLOTS - 1)
    return slots, values


@lru_cache(maxsize=4)
def vocabulary(model: str = MODEL) -> Vocabulary:
    """Read from a SentencePiece model of merge type with byte fallback; once for each Python worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids, scores, raw, spelt = {}, {}, [], [sp.unk_id()] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            spelt[int(piece[3:5], 16)] = i
            raw.append(bytes((int(piece[3:5], 16),)))
        elif sp.is_control(i) or sp.is_unknown(i):
            raw.append(b"")
        else:
            ids[piece], scores[piece] = i, sp.get_score(i)
            raw.append(piece.replace(BLANK, " ").encode())
    if len(raw) > 1 << 16:
        raise ValueError("a vocabulary of 65,536 pieces at most")
    pieces = {i: p for p, i in ids.items()}
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True), 1)}
    pairs = {ids[a] << 16 | ids[b]: order[scores[p]] << 16 | i for p, i in ids.items() for k in range(1, len(p)) if (a := p[:k]) in ids and (b := p[k:]) in ids}
    merged = {p: scores[p] for p in {pieces[x & 0xFFFF] for x in pairs.values()}}
    often = Counter(merged.values())
    letters = "".join(sorted({c for p, score in merged.items() if often[score] > 1 for c in p}))
    tied = re.compile(f"[{re.escape(letters)}]{{2}}" if letters else r"(?!)")
    characters = np.full(0x110000, -1, np.int32)
    for p, i in ids.items():
        if len(p) == 1:
            characters[ord(p)] = i
    return Vocabulary(ids, pairs, tuple(raw), tuple(spelt), characters, *slots_of(pairs), tied)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def gaps(keys: np.ndarray, turns: np.ndarray | int, dropout: float) -> np.ndarray:
    """How many candidates come up between skips: of each key's hash sequence the place `turns`, from 1, as a geometric draw."""
    u = ((mixed(keys + np.asarray(turns, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.minimum(np.log(u) / np.log1p(-dropout), 1e6).astype(np.int64) if dropout < 1 else np.zeros(u.shape, np.int64)


def skipped_places(key: int, dropout: float) -> Iterator[int]:
    """Which of the candidates that come up under a key are skipped, in order."""
    place, turn = -1, 1
    while dropout:
        for gap in gaps(np.full(16, key, np.uint64), np.arange(turn, turn + 16), dropout).tolist():
            place += gap + 1
            yield place
        turn += 16
    yield 1 << 62


def merge(unit: str, v: Vocabulary, dropout: float, key: int) -> list[int]:
    """Ids of one unit. The agenda gives the best candidate, the leftmost of equals; those that skipped_places names for the key, by the order in which they come up, are skipped."""
    n, pairs = len(unit), v.pairs
    skips = skipped_places(key, dropout)
    turn, skip = 0, next(skips)
    # pieces by their ids; a character without a piece has none and never merges
    parts = [v.ids.get(c, -1) for c in unit]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    shift = n.bit_length()
    mask = (1 << shift) - 1
    # an entry is rank and place in one number
    agenda = [p >> 16 << shift | i for i in range(n - 1) if (p := pairs.get(parts[i] << 16 | parts[i + 1]))]
    heapq.heapify(agenda)
    while agenda:
        entry = heapq.heappop(agenda)
        i = entry & mask
        j = after[i]
        if j >= n or parts[i] is None:
            continue
        p = pairs.get(parts[i] << 16 | parts[j])
        if p is None or p >> 16 != entry >> shift:
            continue
        both = p & 0xFFFF
        turn += 1
        if turn > skip:
            skip = next(skips)
            continue
        parts[i], parts[j] = both, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if p := pairs.get(both << 16 | parts[k]):
                heapq.heappush(agenda, p >> 16 << shift | i)
        if (h := before[i]) >= 0 and (p := pairs.get(parts[h] << 16 | both)):
            heapq.heappush(agenda, p >> 16 << shift | h)
    out: list[int] = []
    for i, p in enumerate(parts):
        if p is not None:
            if p < 0:
                out.extend([v.spelt[b] for b in unit[i].encode()])
            else:
                out.append(p)
    return out


def merge_many(units: list[str], skips: list[int], v: Vocabulary) -> tuple[list[bytes], list[int]]:
    """Ids of short units whose characters all have pieces, and how many candidates came up, side by side: a row of pieces and a row of candidates for each,
    the best candidate of every row at a time. The bits of skips say which are skipped, the first to come up lowest; a short unit has fewer than 128."""
    n = len(units)
    lengths = np.fromiter(map(len, units), np.int64, n)
    wide = int(lengths.max()) + 1  # the last column stands beside both ends: it has no piece, so nothing merges with it
    column = np.arange(wide)
    parts = np.full((n, wide), -1, np.int32)
    parts[column < lengths[:, None]] = v.characters[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
    agenda = np.full((n, wide), NEVER, np.uint32)
    agenda[:, :-1] = v.find(parts[:, :-1], parts[:, 1:])
    after, before = np.tile(np.minimum(column + 1, wide - 1).astype(np.int32), (n, 1)), np.tile(np.roll(column, 1).astype(np.int32), (n, 1))
    before[:, 0] = wide - 1
    words = [np.array([x >> k & (1 << 64) - 1 for x in skips], np.uint64) for k in (0, 64)]
    counts = np.zeros(n, np.int64)
    done, rows, turn = parts, np.arange(n), 0
    while True:
        i = agenda.argmin(1)
        base = np.arange(0, agenda.size, wide)
        best = agenda.ravel()[base + i]
        on = np.flatnonzero(best != NEVER)
        if 2 * len(on) < len(best):
            # what is finished stays behind
            if parts is not done:
                done[rows] = parts
            if not len(on):
                break
            rows, parts, agenda, after, before, i, best = rows[on], parts[on], agenda[on], after[on], before[on], i[on], best[on]
            on, base = np.arange(len(rows)), base[: len(rows)]
        counts[rows[on]] += 1
        skipped = (words[turn >> 6][rows[on]] >> np.uint64(turn & 63) & np.uint64(1)).astype(bool)
        turn += 1
        p, a, nexts, lasts = parts.ravel(), agenda.ravel(), after.ravel(), before.ravel()
        at = base[on] + i[on]
        a[at[skipped]] = NEVER
        on, at = on[~skipped], at[~skipped]
        start, left, both = base[on], i[on], (best[on] & np.uint32(0xFFFF)).astype(np.int32)
        gone = start + nexts[at]
        following = nexts[gone]
        p[at], p[gone], a[gone] = both, -1, NEVER
        nexts[at] = following
        lasts[start + following] = left
        previous = start + lasts[at]
        a[at] = v.find(both, p[start + following])
        a[previous] = v.find(p[previous], both)
    alive = done >= 0
    ends = np.cumsum(alive.sum(1) * 4).tolist()
    ids = done[alive].tobytes()
    return [ids[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)], counts.tolist()


#: Merges never cross from a word to the blanks before the next one, nor a line feed, which has no piece.
UNIT = re.compile(rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+")


class Encoder:
    """Encodes texts for one model, dropout and seed.

    Every occurrence of a unit draws its skips by a hash of its document and its place there: how many candidates come up until the next skip. What
    is cut how depends on the skipped candidates only, so a segmentation is kept for each unit and set of skips that came up (a state), in a bounded number.
    Long units, and those with characters that have no piece, are merged for each occurrence.
    """

    def __init__(self, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, kept: int = KEPT):
        self.v, self.dropout, self.seed, self.kept = vocabulary(model), dropout, seed, kept
        self.mark = np.asarray([self.v.spelt[b] for b in BLANK.encode()], np.int32).tobytes()
        self.forget()

    def forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.children: dict[int, int] = {}
        self.units: list[str] = []
        self.skips: list[int] = []
        self.cuts: list[bytes] = []
        #: how many candidates come up; -1 for what is merged for each occurrence
        self.counts = np.zeros(1024, np.int64)

    def add(self, units: list[str], skips: list[int], cuts: list[bytes], counts: list[int]) -> range:
        first, n = len(self.units), len(self.units) + len(units)
        self.units += units
        self.skips += skips
        self.cuts += cuts
        if n > len(self.counts):
            self.counts = np.r_[self.counts, np.zeros(n, np.int64)]
        self.counts[first:n] = counts
        return range(first, n)

    def add_merged(self, units: list[str], skips: list[int]) -> list[int]:
        """States of short units with skips."""
        out = [0] * len(units)
        order = sorted(range(len(units)), key=lambda k: len(units[k]))  # rows of a block are about as wide
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            u, s = [units[k] for k in part], [skips[k] for k in part]
            for k, state in zip(part, self.add(u, s, *merge_many(u, s, self.v)), strict=True):
                out[k] = state
        return out

    def add_roots(self, units: list[str]) -> None:
        """States of units without skips."""
        tied, short, single = self.v.tied.search, [], []
        for u in units:
            (single if len(u) > SHORT or tied(u) else short).append(u)
        if short:
            codes = np.frombuffer("".join(short).encode("utf-32-le"), "<u4")
            known = np.minimum.reduceat(self.v.characters[codes], np.cumsum([0, *map(len, short[:-1])])) >= 0
            many = [u for u, good in zip(short, known.tolist(), strict=True) if good]
            single += [u for u, good in zip(short, known.tolist(), strict=True) if not good]
            self.roots.update(zip(many, self.add_merged(many, [0] * len(many)), strict=True))
        find, pairs = self.v.ids.get, self.v.pairs
        merges = [bool(self.dropout) and any((find(a, -1) << 16 | find(b, -1)) in pairs for a, b in zip(u, u[1:], strict=False)) for u in single]
        cuts = [b"" if live else array("i", merge(u, self.v, 0.0, 0)).tobytes() for u, live in zip(single, merges, strict=True)]
        self.roots.update(zip(single, self.add(single, [0] * len(single), cuts, [-int(live) for live in merges]), strict=True))

    def draw(self, states: np.ndarray, keys: np.ndarray) -> None:
        """Moves each occurrence from its unit's state without skips to that with those it draws."""
        if not self.dropout:
            return
        on, start, turn = np.arange(len(states)), np.zeros(len(states), np.int64), 0
        while len(on):
            turn += 1
            # how many candidates come up before the next that is skipped
            place = start + gaps(keys[on], turn, self.dropout)
            hit = place < self.counts[states[on]]
            on, place = on[hit], place[hit]
            if not len(on):
                break
            made, of = np.unique(states[on] << 32 | place, return_inverse=True)
            made = made.tolist()
            new = [k for k in made if k not in self.children]
            parents = [k >> 32 for k in new]
            skips = [self.skips[x] | 1 << (k & 0xFFFFFFFF) for x, k in zip(parents, new, strict=True)]
            self.children.update(zip(new, self.add_merged([self.units[x] for x in parents], skips), strict=True))
            states[on] = np.fromiter(map(self.children.__getitem__, made), np.int64, len(made))[of]
            start = place + 1

    def encode_many(self, texts: list[str], doc_keys: list[int | None]) -> list[np.ndarray]:
        """Ids of texts. A blank mark in a text itself is spelt by bytes."""
        if len(self.units) > self.kept:
            self.forget()
        # units of the spans between blank marks; the first span of a text has a blank before it
        spans = [[UNIT.findall(("" if k else BLANK) + span.replace(" ", BLANK)) for k, span in enumerate(t.split(BLANK))] if t else [] for t in texts]
        flat = [u for of_text in spans for span in of_text for u in span]
        self.add_roots([u for u in dict.fromkeys(flat) if u not in self.roots])
        states = np.fromiter(map(self.roots.__getitem__, flat), np.int64, len(flat))
        sizes = [sum(map(len, of_text)) for of_text in spans]
        documents = np.array([xxhash.xxh64_intdigest(str(k), self.seed) for k in doc_keys], np.uint64)
        places = np.arange(len(flat)) - np.repeat(np.cumsum([0, *sizes])[:-1], sizes)
        keys = mixed(np.repeat(documents, sizes) + mixed(places.astype(np.uint64)))
        self.draw(states, keys)
        cuts = list(map(self.cuts.__getitem__, states.tolist()))
        for k in np.flatnonzero(self.counts[states] < 0).tolist():
            cuts[k] = array("i", merge(flat[k], self.v, self.dropout, int(keys[k]))).tobytes()
        ids, at = [], 0
        for of_text in spans:
            parts = []
            for span in of_text:
                parts.append(b"".join(cuts[at : at + len(span)]))
                at += len(span)
            ids.append(np.frombuffer(self.mark.join(parts), np.int32))
        return ids

    def encode(self, text: str, doc_key: int | None) -> np.ndarray:
        return self.encode_many([text], [doc_key])[0]

    def decode(self, ids: np.ndarray) -> str:
        return decode(ids, self.v)


def decode(ids: np.ndarray | list[int], v: Vocabulary) -> str:
    """The text of ids: what they say put together, without the blank that every text starts with. Control ids say nothing."""
    return b"".join(map(v.raw.__getitem__, np.asarray(ids).tolist())).removeprefix(b" ").decode(errors="replace")


def encode_documents(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids, n_pieces, and whether the ids decode to the text again, for every row.

    With dropout 0 the ids are those of the SentencePiece library; else each word is cut by a draw of its own, keyed by doc_id and its place in the text. A null text counts as empty and has no ids; a null doc_id is a key like any
    other; repeated rows come out alike. Only the model's path travels with the job: each worker reads the file where it is installed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(model, dropout, seed)
        for b in batches:
            # a long text doesn't share its batch with others
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = e.encode_many(texts, part.column(0).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                same = pa.array([e.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array([len(i) for i in ids], pa.int64()), same], ["doc_id", "ids", "n_pieces", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with text in place of ids."""

    @F.pandas_udf("string")
    def run(ids):  # noqa: ANN001, ANN202
        v = vocabulary(model)
        return ids.map(lambda x: None if x is None else decode(x, v))

    return encoded.withColumn("text", run("ids")).drop("ids")
