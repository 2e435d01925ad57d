"""Quality rules: one table of thresholds, compiled into one Spark projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, whole_text, words_of

#: Frequent words of the languages that the rules know.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "das dem den der des die ein eine für ich im in ist mit nicht sich sie und von zu "
    "al como con de del el en es esta la las lo los no para por que se su un una y"
).split()
SYMBOLS = "#*$%&|<>"
#: Fixed values of the base rule.
MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20


@dataclass(frozen=True)
class Rule:
    """The document fails if the metric is under least or over most."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The default verdict. Lower bounds of zero words can't be met by accident: the base rule already rejects short texts.
RULES = (
    Rule("n_words", least=10, most=1_000_000),
    Rule("mean_word_chars", least=1.5, most=25.0),
    Rule("symbol_ratio", most=0.25),
    Rule("stop_ratio", least=0.02),
    Rule("upper_ratio", most=0.6),
    Rule("dup_line_ratio", most=0.5),
    Rule("distinct_word_ratio", least=0.02),
)


def repeated_words(words: Column, spots: Column) -> Column:
    """Number of words inside windows of the sorted start positions in spots."""
    ends = F.transform(spots, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(spots, k + 1) - p, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(ends, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the metrics of the rules; columns of docs with these names are replaced.

    Words are runs of characters other than ASCII white space. A null or empty text has no words, symbols or lines; each ratio of
    nothing is 0. Windows of five words are told apart by their 64-bit hash within one text.
    """
    names = docs.columns
    own = "_q_"
    while any(n.startswith(own) for n in names):
        own += "_"
    carried = [F.col(f"`{n}`") for n in names]
    at = docs.select(*carried, whole_text().alias(own + "t")).withColumns({own + "w": words_of(F.col(own + "t"))})
    w = F.col(own + "w")
    at = at.withColumn(own + "n", F.size(w))
    # arrays of longs, so that array_distinct stays on primitive values
    starts = F.when(F.col(own + "n") >= WINDOW, F.sequence(F.lit(0), F.col(own + "n") - WINDOW)).otherwise(F.array().cast("array<int>"))
    at = at.withColumn(own + "h", F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    h = F.col(own + "h")
    at = at.withColumn(own + "s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(own + "s")
    again = F.filter(s, lambda x, k: (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))))
    at = at.withColumn(own + "p", F.array_sort(F.transform(again, lambda x: x["i"])))
    t, n = F.col(own + "t"), F.col(own + "n")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    at = at.withColumns({own + "l": lines, "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"), "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")})
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    stop = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])
    dup_lines = F.size(F.col(own + "l")) - F.size(F.array_distinct(F.col(own + "l")))
    return at.withColumns(
        {
            "n_words": n.cast("long"),
            "n_dup_lines": dup_lines.cast("long"),
            "n_repeat_words": F.when(F.col(own + "s").isNull(), F.lit(0).cast("long")).otherwise(repeated_words(w, F.col(own + "p"))),
            "mean_word_chars": share(F.col("word_chars"), n),
            "symbol_ratio": share(F.col("n_symbols"), n),
            "stop_ratio": share(n - F.size(F.filter(w, lambda x: ~F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*dict.fromkeys(STOP_WORDS)))), n),
            "upper_ratio": share(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), F.col("word_chars")),
            "dup_line_ratio": share(dup_lines, F.size(F.col(own + "l"))),
            "distinct_word_ratio": share(F.size(F.array_distinct(w)), n),
        }
    ).drop(own + "t", own + "w", own + "n", own + "h", own + "s", own + "p", own + "l")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: no rule fails."""
    good = F.lit(True)
    for r in rules:
        m = F.coalesce(F.col(r.metric).cast("double"), F.lit(0.0))
        if r.least is not None:
            good = good & (m >= r.least)
        if r.most is not None:
            good = good & (m <= r.most)
    return good


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with counts, metrics, base_failed and kept. One projection, no shuffle; repeated rows get the same verdict each."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measure(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
