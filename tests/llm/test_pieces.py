import random

import numpy as np
import sentencepiece

from emberloom.llm.pieces import DROPOUT, MODEL, Encoder, decode_documents, encode_documents, merge, merge_many, mixed, skipped_places, vocabulary


def test_without_dropout_the_ids_are_the_librarys(rows):
    sp, e = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(dropout=0.0)
    for r in rows:
        if r[1] and "▁" not in r[1]:
            assert e.encode(r[1], r[0]).tolist() == sp.encode(r[1])


def test_dropout_varies_and_decodes(rows):
    e, other, plain = Encoder(), Encoder(seed=18), Encoder(dropout=0.0)
    varied = 0
    for r in rows:
        ids = e.encode(r[1] or "", r[0])
        assert e.decode(ids) == (r[1] or "")
        assert other.decode(other.encode(r[1] or "", r[0])) == (r[1] or "")
        varied += ids.tolist() != plain.encode(r[1] or "", r[0]).tolist()
    assert varied > len(rows) / 2


def test_forgetting_changes_nothing(rows):
    small, large = Encoder(kept=5), Encoder()
    for r in rows[:40]:
        assert small.encode(r[1] or "", r[0]).tolist() == large.encode(r[1] or "", r[0]).tolist()


def test_full_dropout_keeps_characters():
    e = Encoder(dropout=1.0)
    assert len(e.encode("abc de", 1)) == 7 and e.decode(e.encode("abc de", 1)) == "abc de"


def test_documents(docs, rows, none):
    got = encode_documents(docs)
    assert got.filter("lossless").count() == len(rows)
    back = {r.doc_id: r.text for r in decode_documents(got).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    again = {r.doc_id: r.ids for r in encode_documents(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.ids for r in got.collect()}
    assert encode_documents(none).count() == 0


def test_occurrences_are_cut_each_in_its_own_way():
    e, v = Encoder(), vocabulary()
    unit = "▁international"
    plain = merge(unit, v, 0.0, 0)
    got = e.encode_many([" ".join(["international"] * 4000), *["international"] * 4000], range(4001))
    texts = [e.v.raw[i] for i in got[0].tolist()]
    cuts, now = [], []
    for x in texts:
        if x.startswith(b" ") and now:
            cuts.append(tuple(now))
            now = []
        now.append(x)
    cuts.append(tuple(now))
    whole = tuple(v.raw[i] for i in plain)
    assert len(cuts) == 4000 and len(set(cuts)) > 20 and len({x.tobytes() for x in got[1:]}) > 20
    # as often whole as with merges one by one, inside a document and between documents
    want = np.mean([merge(unit, v, DROPOUT, k * 7919) == plain for k in range(4000)])
    for share in (cuts.count(whole) / 4000, np.mean([x.tolist() == plain for x in got[1:]])):
        assert abs(share - want) < 0.04
    assert [x.tolist() for x in e.encode_many(["international"] * 2, [7, 7])] == [got[7].tolist()] * 2


def test_long_units_vary_too():
    e = Encoder()
    got = e.encode("internationalisation" * 3 + " " + "internationalisation" * 3, 1)
    at = [k for k, i in enumerate(got.tolist()) if e.v.raw[i].startswith(b" ")]
    assert len(at) == 2 and got[: at[1]].tolist() != got[at[1] :].tolist()


def plainly(unit, v, skipped):
    """Ids of a unit, looking through all neighbours anew for each candidate: the best score, the leftmost of equals; a skipped candidate stays out until a neighbour changes."""
    parts, out, turn = [(v.ids.get(c, -1), k) for k, c in enumerate(unit)], set(), 0
    while True:
        met = [(p >> 16, k) for k in range(len(parts) - 1) if (p := v.pairs.get(parts[k][0] << 16 | parts[k + 1][0])) and (parts[k], parts[k + 1]) not in out]
        if not met:
            break
        _, k = min(met)
        turn += 1
        if turn - 1 in skipped:
            out.add((parts[k], parts[k + 1]))
        else:
            parts[k : k + 2] = [(v.pairs[parts[k][0] << 16 | parts[k + 1][0]] & 0xFFFF, (parts[k], parts[k + 1]))]
    flat = [(p, k) for p, k in parts]
    return [i for p, k in flat for i in ([p] if p >= 0 else [v.spelt[b] for b in unit[k].encode()])]


def test_all_ways_cut_alike_and_as_a_plain_agenda_does():
    v, rng = vocabulary(), random.Random(5)
    alphabet = "etaoinshrdluéß▁ñ中xq"
    units = ["▁" + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 24))) for _ in range(250)] + ["▁international", "▁▁▁▁▁▁▁", "▁a", "\n\n"]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        for k, u in enumerate(units):
            key = int(mixed(np.array([k], np.uint64))[0])
            skipped = set()
            for place in skipped_places(key, dropout):
                if place >= 128:
                    break
                skipped.add(place)
            want = plainly(u, v, skipped)
            assert merge(u, v, dropout, key) == want
            if not v.tied.search(u) and all(c in v.ids for c in u):
                cut, n = merge_many([u, "▁a"], [sum(1 << x for x in skipped), 0], v)
                assert np.frombuffer(cut[0], np.int32).tolist() == want and n[1] == 1


def test_the_encoder_draws_for_each_place_what_single_merges_draw(rows):
    """Every unit of a document is cut as a single merge under the key of its document and place cuts it, whichever way it goes."""
    import xxhash

    from emberloom.llm.pieces import BLANK, SEED, UNIT

    e, v = Encoder(), vocabulary()
    for r in rows[4:40]:
        text = r[1]
        if not text or BLANK in text:
            continue
        document = np.uint64(xxhash.xxh64_intdigest(str(r[0]), SEED))
        units = UNIT.findall(BLANK + text.replace(" ", BLANK))
        keys = mixed(document + mixed(np.arange(len(units)).astype(np.uint64)))
        want = [i for u, k in zip(units, keys.tolist(), strict=True) for i in merge(u, v, DROPOUT, k)]
        assert e.encode(text, r[0]).tolist() == want
