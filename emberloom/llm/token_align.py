"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often the corpus links two ids."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Fixed value: what a byte-level vocabulary without a pattern of its own cuts texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a blank that follows no white space and no blank follows, each tokenizer starts a token, whatever stands there: their tokens of a text are those of the spans between.
CUT = re.compile(r" (?<=\S )(?=[^ ])")
#: A worker remembers spans of so many characters altogether, and takes texts of about so many at a time.
REMEMBERED, AT_ONCE = 4_000_000, 1_000_000
#: Id pairs above the FREQUENT-th part of all links are looked up by broadcast: there can't be more than FREQUENT of them.
FREQUENT = 1 << 18
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


class Bits:
    """Packed marks at byte places, with ranks by population counts and places by rank."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each place."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


def bytes_of_first(path: str) -> list[bytes]:
    """Bytes by id of a byte-level vocabulary: printable bytes stand for themselves, the others for characters from 256 on, in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    found = {i: bytes(byte[c] for c in t) for t, i in told["model"]["vocab"].items() if all(c in byte for c in t)}
    found |= {t["id"]: t["content"].encode() for t in told.get("added_tokens", ())}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def bytes_of_second(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


def encoder_of(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level vocabulary, no token special. Where ids are in the order of merges, as those of tiktoken's ranks are, tiktoken gives the same ids in a fraction of the time."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    merges = [m if isinstance(m, str) else "".join(m) for m in told["model"]["merges"]]
    own = {t["content"] for t in told.get("added_tokens", ()) if t["special"]}
    ids = {t: i for t, i in told["model"]["vocab"].items() if t not in own}
    plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and sorted(ids.values()) == list(range(256 + len(merges))) and all(ids[m.replace(" ", "")] == 256 + k for k, m in enumerate(merges)):
        raw = bytes_of_first(path)
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={raw[i]: i for i in ids.values()}, special_tokens={}).encode_ordinary
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Aligner:
    """Tokens of both tokenizers over the spans of texts, remembered by span; `whole` takes each text as one span.

    Both see a blank before the text. Ids are looked at by what bytes they say, so a span whose bytes don't come back from either makes its text one without tokens.
    """

    def __init__(self, first: str = FIRST, second: str = SECOND, whole: bool = False, remembered: int = REMEMBERED):
        self.encode_first = encoder_of(first)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        self.raw = bytes_of_first(first), bytes_of_second(self.second)
        # a piece that goes on over a blank would hold spans together
        self.whole = whole or any(" " in r.lstrip(b" ").decode(errors="replace") for r in self.raw[1])
        self.sizes = [np.array(list(map(len, r)), np.int64) for r in self.raw]
        self.comma, self.bar, self.semi, self.bare = ([np.array([f"{i}{c}" for i in range(max(map(len, self.raw)))], object) for c in (",", "|", ";", "")])
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        #: tokens of the first and of the second, groups, and whether its bytes come back, by span; links of a span stand from starts on
        self.counts, self.starts, self.pairs = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, spans: list[str]) -> None:
        """Aligns new spans. Those that begin and end in no white space are tokenized as one text, as what stands beside them changes nothing; the others, and all if bytes don't come back, one by one."""
        plain = [] if self.whole else [s for s in spans if s[0] != " " and not s[-1].isspace()]
        odd = set(spans) - set(plain)
        if plain:
            joined = " ".join(plain)
            ids, data = (self.encode_first(" " + joined), self.second.encode(joined)), (" " + joined).encode(errors="replace")
            if self.says(ids, data):
                self.mark(plain, [np.array(i, np.int64) for i in ids])
            else:
                odd.update(plain)
        if odd:
            each = {s: (self.encode_first(" " + s), self.second.encode(s)) for s in odd}
            good = [s for s in odd if self.says(each[s], (" " + s).encode(errors="replace"))]
            if good:
                self.mark(good, [np.array([x for s in good for x in each[s][k]], np.int64) for k in (0, 1)])
            bad = [s for s in odd if s not in self.known]
            self.keep(bad, np.zeros((len(bad), 4), np.int64), [""] * len(bad), np.zeros(len(bad), np.int64), np.zeros(0, np.int64))

    def says(self, ids: tuple[list[int], list[int]], data: bytes) -> bool:
        return all(b"".join(map(r.__getitem__, i)) == data for i, r in zip(ids, self.raw, strict=True))

    def mark(self, spans: list[str], flat: list[np.ndarray]) -> None:
        """Groups and links of spans, whose tokens follow one another, all in one set of marks: every span ends a token in both."""
        ends = [np.cumsum(s[f]) - 1 for s, f in zip(self.sizes, flat, strict=True)]
        stop = np.cumsum([len(x.encode()) + 1 for x in spans]) - 1
        a, b = (Bits.at(e, int(stop[-1]) + 1) for e in ends)
        both, either = Bits(a.words & b.words), Bits(a.words | b.words)
        cuts, joints = both.places(), either.places()
        upto = [x.rank(cuts) + 1 for x in (a, b)]
        # in order: the first's tokens of a group, then the second's
        group = [both.rank(e) for e in ends]
        place = [np.arange(len(flat[0])) + np.concatenate([[0], upto[1]])[group[0]], np.arange(len(flat[1])) + upto[0][group[1]]]
        last = [cuts[g] == e for g, e in zip(group, ends, strict=True)]
        out = np.empty(len(flat[0]) + len(flat[1]), object)
        out[place[0]] = np.where(last[0], self.bar[flat[0]], self.comma[flat[0]])
        out[place[1]] = np.where(np.isin(ends[1], stop), self.bare[flat[1]], np.where(last[1], self.semi[flat[1]], self.comma[flat[1]]))
        each = [np.diff(np.concatenate([[0], x.rank(stop) + 1])) for x in (a, b, both, either)]
        said, bounds = out.tolist(), np.cumsum([0, *(each[0] + each[1])]).tolist()
        groups = ["".join(said[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
        # every stretch between neighbouring ends lies in one token of each
        pairs = flat[0][a.rank(joints)] << 32 | flat[1][b.rank(joints)]
        self.keep(spans, np.column_stack([*each[:3], np.ones(len(spans), np.int64)]), groups, each[3], pairs)

    def keep(self, spans: list[str], counts: np.ndarray, groups: list[str], links: np.ndarray, pairs: np.ndarray) -> None:
        self.known.update(zip(spans, range(len(self.groups), len(self.groups) + len(spans)), strict=True))
        self.chars += sum(map(len, spans))
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, pairs])

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, id pairs, how often each) of each text."""
        if self.chars > self.remembered:
            self.forget()
        spans = [([t] if self.whole else CUT.split(t)) if t else [] for t in texts]
        sizes = np.array(list(map(len, spans)), np.int64)
        said = list(chain.from_iterable(spans))
        found = list(map(self.known.get, said))
        if None in found:
            self.add(list(dict.fromkeys(s for s, k in zip(said, found, strict=True) if k is None)))
            found = list(map(self.known.__getitem__, said))
        flat, of = np.array(found, np.int64), np.repeat(np.arange(len(texts)), sizes)
        bounds = np.cumsum([0, *sizes]).tolist()
        bad = set(of[self.counts[flat, 3] == 0].tolist())
        total = np.column_stack([np.bincount(of, self.counts[flat, k], len(texts)) for k in range(3)]).astype(np.int64)
        # spans of a text with how often they stand in it, then their links, those alike put together
        each, n = np.unique(of << 32 | flat, return_counts=True)
        of, flat = each >> 32, each & 0xFFFFFFFF
        links = self.starts[flat + 1] - self.starts[flat]
        at = np.repeat(self.starts[flat] - np.cumsum(links) + links, links) + np.arange(int(links.sum()))
        values, slot = np.unique(self.pairs[at], return_inverse=True)
        keys, inverse = np.unique(np.repeat(of, links) << 32 | slot, return_inverse=True)
        times = np.bincount(inverse, np.repeat(n, links), len(keys)).astype(np.int64)
        ends = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
        pairs, out = values[keys & 0xFFFFFFFF], []
        for k, t in enumerate(texts):
            if not t or k in bad:
                out.append((0, 0, 0, 0, "", pairs[:0], times[:0]))
                continue
            a, b = ends[k], ends[k + 1]
            groups = ";".join(map(self.groups.__getitem__, found[bounds[k] : bounds[k + 1]]))
            out.append((*total[k].tolist(), int(times[a:b].sum()), groups, pairs[a:b], times[a:b]))
        return out


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND, whole: bool = False) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups, and the id pairs that are linked (first << 32 | second) with how often, of every document.

    groups is `a1,a2|b1;a3|b2,b3`: ids of both tokenizers between the byte places where tokens of both end. Token ends are marked in packed bits; their AND has the shared cuts, and ranks by
    population count turn byte places into token numbers; the OR's places give the links. row numbers the rows. A text that is null or empty, or whose bytes
    either tokenizer doesn't give back (one with U+2581), has no tokens: zeros and an empty string. Special tokens' names are plain text. Rows alike come out alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second, whole)
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < AT_ONCE:
                    chars += len(texts[end] or "")
                    end += 1
                rows = list(zip(*aligner.align(texts[at:end]), strict=True))
                lists = []
                for k in (5, 6):
                    bounds = pa.array(np.cumsum([0, *map(len, rows[k])]), pa.int32())
                    lists.append(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(rows[k]), pa.int64())))
                columns = [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), *(pa.array(rows[k], pa.int64()) for k in range(4)), pa.array(rows[4], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in ALIGNED.split(", ")])
                at = end

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, ALIGNED)


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of links (pair, times): how many links hold the pair, and whether no pair of its second id has more."""
    counts = stored(links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # as many rows as the second vocabulary has ids
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_documents(docs: DataFrame, first: str = FIRST, second: str = SECOND, frequent: int = FREQUENT, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document (and groups, if asked for).

    n_best counts the links whose pair is the most frequent of its second id in the whole corpus, ties included; count_sum sums the corpus counts of all links. Documents are tokenized once; their distinct pairs are
    stored. Frequent pairs, of which there are `frequent` at most, meet their counts by broadcast, so that no task gets what every text holds; the rest are joined.
    """
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    told = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links"]
    texts = stored(aligned(docs, first, second).select(*told, digest, *(["groups"] if keep_groups else []), "pairs", "times"), "aligned")
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), "l.times")
    counts = stored(link_counts(links), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(1, total // frequent)
    met = links.join(F.broadcast(counts.filter(often)), "pair", "left")
    seldom = met.filter("n is null").select("row", "pair", "times").join(counts.filter(~often), "pair")
    summed = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = summed(met.filter("n is not null")).unionByName(summed(seldom)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = texts.drop("pairs", "times").join(sums, "row", "left")
    return out.select(*told[1:], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256", *(["groups"] if keep_groups else []))
