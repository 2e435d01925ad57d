import re

from emberloom.llm.quality_rules import apply_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_counts_are_those_of_brute_force(docs, rows):
    got = apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(tuple(r[:7]) for r in got) == sorted((r[0], *brute(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_verdict_follows_the_table(spark):
    clean = "the house of the hill stands in a quiet valley and it is old but well kept by its people"
    d = spark.createDataFrame([(1, clean), (2, " ".join(f"{w}###" for w in clean.split())), (3, clean.upper())], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in apply_rules(d).collect()} == {1: True, 2: False, 3: False}


def test_no_python_and_no_shuffle(docs):
    plan = apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(none):
    assert apply_rules(none).count() == 0
