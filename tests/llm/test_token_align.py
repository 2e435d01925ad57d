import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberloom.llm import token_align
from emberloom.llm.token_align import FIRST, SECOND

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n a", "x  y", "x   y", "a\x85 b", "a\x1c b", "▁", "a▁ b", "ﬁ ① é é 　x", "<s> </s> <0x41> <|endoftext|> <unk>", "a\x00b c",
    "日本語のテキスト です 漢字", "𝒳𝒴 emoji 👩‍👩‍👧‍👦 ok", "don't we'll I'd", "1234567 8 90,123.45", "tab\tand\r\nlines\n\n\nend", "a" * 5000, "word " * 3000, "   lead and trail   ", "é " * 3, "퟿� ﻿ bom",
]


def table_a():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


def plainly(texts):
    """Each text tokenized as a whole, each pair of tokens compared by its bytes."""
    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    byte = table_a()
    per, corpus = [], Counter()
    for t in texts:
        a = b = []
        if t:
            enc = first.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(byte[c] for c in s)) for i, s in zip(enc.ids, enc.tokens, strict=True)]
            ids = second.encode(t)
            b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, second.id_to_piece(i)) for i in ids)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
                a = b = []
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, x in side:
                found.append((at, at + len(x), i))
                at += len(x)
            spans.append(found)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= c) for side in spans))
            low = c
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, spans[1][j][2]))
                j += 1
        corpus.update(links)
        per.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = {}
    for (_, b), n in corpus.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, g, len(ls), sum(corpus[x] == best[x[1]] for x in ls), sum(corpus[x] for x in ls), hashlib.sha256(s.encode()).hexdigest() if s else "") for a, b, g, ls, s in per]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    pieces = ["the", " ", "  ", "\n", " \n", "Straße", "日本", "x1", "…", "\t", "'s", "naïve", "▁", "𝒳", ".", ",", " ", "　", "zzz", "-"]
    made = ["".join(rng.choices(pieces, weights=[9, 12, 2, 2, 1, 3, 2, 3, 1, 1, 2, 2, 0.05, 1, 3, 3, 0.5, 0.3, 2, 1], k=rng.randint(1, 120))) for _ in range(200)]
    return [*ODD, *made, made[0], made[0]]


@pytest.mark.parametrize("frequent", [token_align.FREQUENT, 20, 1])
def test_every_way_gives_the_links_of_a_plain_reading(spark, texts, frequent):
    df = spark.createDataFrame([(k % 200, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = token_align.link_documents(df, frequent=frequent).collect()
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got]
    want = [(k % 200, *x) for k, x in enumerate(plainly(texts))]
    assert sorted(rows) == sorted(want) and sum(r[1] == 0 for r in rows) > 4


def test_spans_and_whole_texts_give_the_same(texts):
    kept = [t for t in texts if t]
    a, b, c = token_align.Aligner(), token_align.Aligner(whole=True), token_align.Aligner(remembered=0)
    as_list = lambda rows: [(*r[:5], dict(zip(r[5].tolist(), r[6].tolist(), strict=True))) for r in rows]
    want = as_list(b.align(kept))
    assert as_list(a.align(kept)) == want and as_list(a.align(kept)) == want
    assert [as_list(c.align([t]))[0] for t in kept] == want


def test_all_documents_come_out_as_whole_texts(spark):
    """Spans against whole texts over a given table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    a, b = token_align.aligned(docs).select(*columns).collect(), token_align.aligned(docs, whole=True).select(*columns).collect()
    assert sorted(a) == sorted(b) and sum(r.n_links for r in a) > 10_000


def test_groups_are_shown_and_an_empty_table_gives_none(spark, none):
    out = token_align.link_documents(spark.createDataFrame([(1, "Hello there")], "doc_id long, text string"), keep_groups=True).first()
    assert out.n_groups == out.groups.count(";") + 1 and hashlib.sha256(out.groups.encode()).hexdigest() == out.groups_sha256
    assert token_align.link_documents(none).count() == 0
    assert token_align.link_documents(spark.createDataFrame([(None, None)], "doc_id long, text string").withColumn("pair", F.lit(1))).first().n_links == 0


def test_both_ways_to_encode_give_the_same_ids(texts, tmp_path):
    import json

    told = json.loads(open(FIRST, encoding="utf-8").read())
    (tmp_path / "other.json").write_text(json.dumps(told | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [told["pre_tokenizer"]]}}))
    fast, slow = token_align.encoder_of(FIRST), token_align.encoder_of(str(tmp_path / "other.json"))
    assert fast.__qualname__ != slow.__qualname__ and all(fast(" " + t) == slow(" " + t) for t in texts if t)
