import random
import re
from collections import Counter

from emberloom.llm.chat import link_replies, quote_links

SCHEMA = "conv_id long, turn long, role string, text string, position string, depth string"


def run(spark, rows):
    got = link_replies(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    return {(r.conv_id, r.turn): r for r in got.collect()}


def test_quotes_lead_to_their_messages(spark):
    got = run(
        spark,
        [
            (1, 0, "user", "Hello there\nHow are you?"),
            (1, 1, "assistant", "Fine.\nWhat now?"),
            (1, 2, "user", "> HOW   are you?\nI asked"),
            (1, 3, "assistant", ">> How are you?\n> I asked\nYes"),
            (1, 4, None, "> nobody said this\nx"),
            (2, 0, "user", "> Hello there\nother conversation"),
            (None, 0, "user", None),
        ],
    )
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 3, (2, 0): None, (None, 0): None}
    assert got[1, 3].content == "Yes" and got[1, 3].max_level == 2 and got[1, 3].depth == 2 and got[1, 3].thread_turn == 0
    assert got[1, 3].rendered == "<|assistant|>\nYes\n<|end|>" and got[1, 4].rendered.startswith("<|user|>")
    assert got[None, 0].content == "" and not got[2, 0].quotes


def test_every_reply_comes_after_its_parent(spark):
    rows = [(c, t, "user", (f"> said {t // 2}\n" if t % 3 == 2 else "") + f"said {t}") for c in (1, 2) for t in range(40)]
    got = run(spark, rows)
    for (c, _), r in got.items():
        if r.parent_turn is not None:
            assert got[c, r.parent_turn].position < r.position
    for c in (1, 2):
        assert sorted(r.position for k, r in got.items() if k[0] == c) == list(range(40))
    assert got[1, 5].parent_turn == 2


def test_native_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert link_replies(none).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a", "", "")] * 3, SCHEMA)
    assert link_replies(twice).count() == 3


def test_deeper_quotes_lead_to_their_messages(spark):
    rows = [
        (1, 0, "user", "first words\nmore words"),
        (1, 1, "assistant", "second words"),
        (1, 2, "user", "third words"),
        (1, 3, "assistant", ">> first words\n>> second words\n>> more words\nonly at level 2"),
        (1, 4, "user", "> edited since\n>> edited too\n>>> second words\nonly at level 3"),
        (1, 5, "user", ">> first words\n>> more words\n> third words\nthe shallowest counts"),
    ]
    got = run(spark, rows)
    assert {k[1]: r.parent_turn for k, r in got.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    assert got[1, 3].quotes and got[1, 4].quotes and got[1, 4].max_level == 3
    links = quote_links(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sorted((r.turn, r.level, r.origin_turn, r.n) for r in links) == [(3, 2, 0, 2), (3, 2, 1, 1), (4, 3, 1, 1), (5, 1, 2, 1), (5, 2, 0, 2)]


def plainly(rows):
    """(conv, turn) -> (parent, thread, depth, content, position), message by message and line by line."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said, parent = {}, {}
        for k, (_, turn, _, text) in enumerate(turns):
            lines = []
            for line in (text or "").split("\n"):
                marks = re.match(r"(?:[ \t]*>)*[ \t]?", line)[0] if re.match(r"[ \t]*>", line) else ""
                words = re.sub(r"[\x20\x09-\x0D]+", " ", line[len(marks) :].lower()).strip(" ")
                lines.append((marks.count(">"), words, line))
            met = Counter((level, said[words]) for level, words, _ in lines if level and words and said.get(words, k) < k)
            best = max(met, key=lambda x: (-x[0], met[x], x[1]), default=None)
            parent[k] = best[1] if best else (k - 1 if k else None)
            for level, words, _ in lines:
                if level == 0 and words:
                    said.setdefault(words, k)
            content = "\n".join(line for level, _, line in lines if level == 0).strip(" \t\n\x0b\x0c\r")
            root, depth = k, 0
            while parent[root] is not None:
                root, depth = parent[root], depth + 1
            out[conv, turn] = [None if parent[k] is None else turns[parent[k]][1], turns[root][1], depth, content, (root, k)]
        for place, key in enumerate(sorted((v[4], t) for (c, t), v in out.items() if c == conv)):
            out[conv, key[1]][4] = place
    return out


def test_links_are_those_of_a_plain_reading(spark):
    rng = random.Random(4)
    sayings = [f"saying number {k} of all" for k in range(12)] + ["Yes", "  Spaced   OUT ", ""]
    rows = []
    for conv in (*range(25), None):
        for turn in range(rng.randint(1, 14)):
            lines = [rng.choice(["", "", "> ", ">> ", "> > ", ">>> ", " >"]) + rng.choice(sayings) for _ in range(rng.randint(0, 5))]
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join(lines) if rng.random() > 0.05 else None))
    want, got = plainly(rows), run(spark, rows)
    assert {k: [r.parent_turn, r.thread_turn, r.depth, r.content, r.position] for k, r in got.items()} == want
    assert len({r.max_level for r in got.values()}) == 4 and sum(r.quotes for r in got.values()) > 20


def test_a_very_long_conversation_ties_and_nulls(spark):
    rows = [(1, t, "user", f"> line {t - 1}\nline {t}") for t in range(1500)]
    got = run(spark, rows)
    assert got[1, 1499].depth == 1499 and got[1, 1499].thread_turn == 0 and got[1, 1499].position == 1499
    odd = [(2, None, None, "a"), (2, None, None, "a"), (2, 5, "user", None), (None, None, None, None)]
    out = link_replies(spark.createDataFrame([(*r, "x", "y") for r in odd], SCHEMA)).collect()
    assert len(out) == 4 and sorted(r.position for r in out if r.conv_id == 2) == [0, 1, 2]


def wrapped(text, width, marks):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines, line = [*lines, line], w
        else:
            line = f"{line} {w}".strip()
    return "\n".join(marks + x for x in [*lines, line])


def test_quotes_wrapped_anew_lead_to_their_messages(spark):
    first = "We will meet at the old station on Monday morning, and whoever comes late has to take the second train on their own."
    second = "Nobody told me about it, so please write down once more when and where exactly you are going to meet on that day."
    other = "Something entirely different that only shares the words at the old station on Monday with what was said before it."
    got = run(
        spark,
        [
            (1, 0, "user", first),
            (1, 1, "assistant", second),
            (1, 2, "user", "short words of mine"),
            (1, 3, "user", wrapped(first, 30, "> ") + "\nreply to 0"),
            (1, 4, "user", wrapped(second, 17, "> ") + "\n\n" + wrapped(first, 23, ">> ") + "\nreply to 1"),
            (1, 5, "user", wrapped(first, 25, ">> ") + "\n>\nreply to 0, deep"),
            (1, 6, "user", wrapped(other, 200, "> ") + "\nfollows the one before"),
            (1, 7, "user", "> and whoever comes late has to\nreply to 0, cut out of a line"),
            (1, 8, "user", "> short words\n> of MINE\nreply to 2"),
            (1, 9, "user", "> the second train\nfollows the one before: too short"),
            (2, 0, "user", wrapped(first, 30, "> ")),
            (None, 0, None, first),
            (None, 1, None, wrapped(first, 30, "> ")),
        ],
    )
    assert {k[1]: r.parent_turn for k, r in got.items() if k[0] == 1} == {0: None, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 5, 7: 0, 8: 2, 9: 8}
    assert {k[1] for k, r in got.items() if k[0] == 1 and r.quotes} == {3, 4, 5, 7, 8} and not got[2, 0].quotes and got[None, 1].quotes


def plain_links(rows):
    """(conv, turn, level, origin) -> lines, word by word: what quote_links says."""
    out = Counter()
    split = lambda words: [tuple(words[s : s + 5]) for s in range(max(len(words) - 4, 1))] if words else []
    for conv in {r[0] for r in rows}:
        lines_said, parts_said = {}, {}
        for k, (_, _, _, text) in enumerate(sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])):
            by_level = {}
            for line in (text or "").split("\n"):
                marks = re.match(r"(?:[ \t]*>)*[ \t]?", line)[0] if re.match(r"[ \t]*>", line) else ""
                words = re.sub(r"[\x20\x09-\x0D]+", " ", line[len(marks) :].lower()).split()
                if words:
                    by_level.setdefault(marks.count(">"), []).append(words)
            for level, lines in by_level.items():
                if not level:
                    continue
                flat = [(n, w) for n, words in enumerate(lines) for w in words]
                word_from = {}
                for s, part in enumerate(split([w for _, w in flat])):
                    if parts_said.get(part, k) < k:
                        for p in range(s, s + len(part)):
                            word_from[p] = max(word_from.get(p, -1), parts_said[part])
                for n, words in enumerate(lines):
                    origin = lines_said.get(" ".join(words), k)
                    if origin == k:
                        from_ = Counter(word_from[p] for p, (m, _) in enumerate(flat) if m == n and p in word_from)
                        if 10 * sum(from_.values()) < 8 * len(words):
                            continue
                        origin = max(from_, key=lambda o: (from_[o], o))
                    out[conv, k, level, origin] += 1
            own = by_level.get(0, [])
            for words in own:
                lines_said.setdefault(" ".join(words), k)
            for part in split([w for words in own for w in words]):
                parts_said.setdefault(part, k)
    return out


def test_wrapped_links_are_those_of_a_plain_reading(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(7)]
    rows, sayings = [], ["Yes", "one two three"]
    for conv in (*range(20), None):
        for turn in range(rng.randint(2, 12)):
            parts = []
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.4:
                    sayings.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))))
                    parts.append(wrapped(sayings[-1], rng.choice([9, 20, 200]), ""))
                else:
                    words = rng.choice(sayings[-8:]).split()
                    a = rng.randrange(len(words))
                    words = words[a : a + rng.randint(1, 25)]
                    parts.append(wrapped(" ".join(words).upper(), rng.choice([6, 13, 40, 200]), rng.choice(["> ", ">> ", ">", " > > "])))
            rows.append((conv, turn, "user", "\n".join(parts) if parts else None))
    links = quote_links(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    want = plain_links(rows)
    assert {(r.conv_id, r.turn, r.level, r.origin_turn): r.n for r in links} == want and len(want) > 40
    assert any(n > 2 for n in want.values())
