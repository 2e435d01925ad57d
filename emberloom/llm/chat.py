"""Chat formatting by quotation linking: quoted passages are linked to the messages that they come from, and conversations follow the replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, ranked, stored, whole_text, words_of

#: The quote marks before a line, each with at most one blank after it.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: Words of a window by which quotes that are wrapped anew are found, and the share of a line's words that windows must cover.
WINDOW, COVERED = 5, 0.8
#: Parts that the messages of one conversation are dealt to.
SALTS = 16


def level_of(line: Column) -> Column:
    """How deep a line is quoted: the number of quote marks before its text."""
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normal(line: Column) -> Column:
    """What is hashed: lower case, white space made one space, no marks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), SPACE + "+", " "))


def passages(lines: Column) -> Column:
    """The lines with words as array<struct<line, level, passage, words>>: their places among these, a passage by the 64-bit hash of its normal form, and the words of a quoted line."""
    worded = F.filter(lines, lambda x: F.regexp_replace(x, MARKS, "").rlike(WORD))
    told = F.transform(worded, lambda x: F.struct(level_of(x).alias("level"), normal(x).alias("normal")))
    words = lambda x: F.when(x["level"] > 0, F.split(x["normal"], " "))
    return F.transform(told, lambda x, k: F.struct(k.alias("line"), x["level"].alias("level"), F.xxhash64(x["normal"]).alias("passage"), words(x).alias("words")))


def windows(items: Column, word: Callable[[Column], Column], also: Callable[[Column], Column] | None = None) -> Column:
    """The windows of WINDOW words of an array of items, from which word takes the word, as array<struct<passage, at>>: the hash, and what also takes from each item. Fewer words are one window, none none."""

    def of(all_: Column) -> Column:
        here = lambda s: [F.get(all_, s + k) for k in range(WINDOW)]
        at = lambda s: F.filter(F.array(*[F.when(x.isNotNull(), also(x)) for x in here(s)]), lambda x: x.isNotNull()) if also else F.lit(None)
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.greatest(F.size(all_) - WINDOW, F.lit(0))))
        return F.transform(starts, lambda s: F.struct(F.xxhash64(F.concat_ws(" ", *[word(x) for x in here(s)])).alias("passage"), at(s).alias("at")))

    return F.get(F.transform(F.array(items), of), F.lit(0))  # items as a variable: worked out once, not for each window


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, message (the place among all), content (own words without quoted lines), and the passages, of each turn; stored, so that texts are dealt and looked through once."""
    base = turns.select("conv_id", "turn", "role", whole_text().alias("text"))
    at = ranked(base.withColumn("_h", F.xxhash64("text", "role")), ["conv_id", "turn", "_h"], "message").drop("all_rows", "_h")
    lines = F.split("text", "\n")
    own = F.array_join(F.filter(lines, lambda x: level_of(x) == 0), "\n")
    return stored(at.select("conv_id", "turn", "role", "message", F.trim(F.regexp_replace(own, rf"^{SPACE}+|{SPACE}+$", "")).alias("content"), passages(lines).alias("said")), "messages")


def quoted_passages(at: DataFrame) -> DataFrame:
    """conv_id, message, level, kind, passage, at: the quoted lines (kind 0), and the windows over all lines of one level (kind 1), each with the words that it covers as array<struct<line, place, words>>."""
    quoted = at.select("conv_id", "message", F.filter("said", lambda x: x["level"] > 0).alias("q")).filter(F.size("q") > 0)
    level = quoted.select("*", F.explode(F.array_distinct(F.transform("q", lambda x: x["level"]))).alias("level"))
    level = level.select("conv_id", "message", "level", F.filter("q", lambda x: x["level"] == F.col("level")).alias("q"))
    words = F.flatten(F.transform("q", lambda x: F.transform(x["words"], lambda w, k: F.struct(w.alias("word"), x["line"].alias("line"), k.alias("place"), F.size(x["words"]).alias("words")))))
    whole = F.transform("q", lambda x: F.struct(x["passage"].alias("passage"), F.array(F.struct(x["line"].alias("line"), F.lit(0).alias("place"), F.size(x["words"]).alias("words"))).alias("at")))
    parts = windows(words, lambda x: x["word"], lambda x: F.struct(x["line"].alias("line"), x["place"].alias("place"), x["words"].alias("words")))
    both = [level.select("conv_id", "message", "level", F.lit(kind).alias("kind"), F.explode(x).alias("p")) for kind, x in enumerate((whole, parts))]
    return both[0].unionAll(both[1]).select("conv_id", "message", "level", "kind", "p.passage", "p.at")


def said_first(at: DataFrame) -> DataFrame:
    """_c, _k, _p, origin: the message that first says a line (kind 0) or a window of words (kind 1) itself, in conversations that quote anything.

    Only those are taken apart. A conversation may hold most messages: its rows are dealt by a salt, its id stands once for each.
    """
    quoting = at.filter(F.exists("said", lambda x: x["level"] > 0)).select(F.col("conv_id").alias("_c")).distinct().withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = at.join(quoting, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("message") % SALTS == F.col("_s")), "left_semi")
    lines = own.select("conv_id", "message", F.lit(0).alias("_k"), F.explode(F.transform(F.filter("said", lambda x: x["level"] == 0), lambda x: x["passage"])).alias("_p"))
    parts = own.select("conv_id", "message", F.lit(1).alias("_k"), F.explode(F.transform(windows(words_of(F.lower("content")), lambda x: x), lambda x: x["passage"])).alias("_p"))
    return lines.unionAll(parts).groupBy(F.col("conv_id").alias("_c"), "_k", "_p").agg(F.min("message").alias("origin"))


def links_of(at: DataFrame) -> DataFrame:
    """message, level, origin, n: how many lines that a message quotes at a level lead to the earlier message origin of its conversation.

    A line leads to the message that first says it as a line. If none does, it may be wrapped anew: where at least COVERED of its words stand in windows that earlier messages say, it leads to the one that most of them are from
    (the latest among equals), a word being from the latest first sayer of a window around it.
    """
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("kind") == F.col("_k")) & (F.col("passage") == F.col("_p"))
    met = quoted_passages(at).join(said_first(at), on).filter("origin < message").select("message", "level", "kind", "origin", F.explode("at").alias("w")).select("message", "level", "kind", "origin", "w.*")
    line = ["message", "level", "kind", "line", "words"]
    words = met.groupBy(*line, "place").agg(F.max("origin").alias("origin")).groupBy(*line, "origin").agg(F.count("*").alias("n"))
    lines = words.groupBy(*line).agg(F.sum("n").alias("covered"), F.max_by("origin", F.struct("n", "origin")).alias("origin"))
    found = lines.filter((F.col("kind") == 0) | (F.col("covered") >= COVERED * F.col("words")))
    return found.groupBy("message", "level", "line").agg(F.min_by("origin", "kind").alias("origin")).groupBy("message", "level", "origin").agg(F.count("*").alias("n"))


def quote_links(turns: DataFrame) -> DataFrame:
    """conv_id, turn, message, level, origin_turn, origin, n: a row for each message that another quotes, by quote level, with the number of lines quoted."""
    at = numbered(turns)
    turn_of = at.select(F.col("message").alias("origin"), F.col("turn").alias("origin_turn"))
    return links_of(at).join(at.select("conv_id", "turn", "message"), "message").join(turn_of, "origin").select("conv_id", "turn", "message", "level", "origin_turn", "origin", "n")


def link_replies(turns: DataFrame, rounds: int = 64) -> DataFrame:
    """A row for each message: conv_id, turn, role, message (its place among all by conv_id, turn), parent_turn, thread_turn, depth, quotes, max_level, content, rendered, position.

    A line's quote level is the number of `>` before it. Each quoted line, of any level, is joined by the hash of its normal form to the first earlier message of the
    conversation that says this line itself; lines that none says as they stand, wrapped anew by a mail program or cut out of longer ones, by hashes of windows of five words over all
    lines of a level (links_of; quote_links has all these links). Of the shallowest level that meets a message, the one that
    gave most lines (the latest among equals) is the parent. Without such a link a message follows the one before it. thread_turn is the root that the parents lead to, position the place of a message in its conversation when threads
    follow one another, each in the order of turns, so that every reply comes after its parent. content is the text without quoted
    lines, rendered puts the role before it.

    Passages meet as minima by hash, so a line that all messages share is pre-aggregated; messages are numbered over ranges, so that a conversation
    of any length is dealt over tasks; a conversation comes out as rows, never as one value. A null conv_id is a conversation of its own, null turns
    come first, rows alike keep a place each, a null text is empty, a null role is shown as "user".
    """
    at = numbered(turns)
    linked = links_of(at).groupBy("message").agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("linked"))
    # the message before, if it is of the same conversation
    before = at.select((F.col("message") + 1).alias("message"), F.col("conv_id").alias("_c"))
    follows = before.join(at.select("message", "conv_id"), "message").filter(F.col("conv_id").eqNullSafe(F.col("_c"))).select("message", (F.col("message") - 1).alias("previous"))
    parents = at.select("message").join(linked, "message", "left").join(follows, "message", "left").select("message", F.coalesce("linked", "previous").alias("parent"), F.col("linked").isNotNull().alias("quotes"))
    # pointers double until all reach a root; steps count the replies on the way
    p = cut(parents.select("message", "parent", "quotes", F.coalesce("parent", "message").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(rounds):
        up = p.select(F.col("message").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        # roots are their own parents: they add nothing
        p = cut(p.join(up, "root").select("message", "parent", "quotes", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("root") != F.col("next")).alias("moved")))
        if not p.filter("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"link_replies: no end after {rounds} rounds")
    turn_of = lambda name: at.select(F.col("message").alias(name), F.col("turn").alias(f"{name}_turn"))
    # places are found from numbers alone; contents join them at the end
    ids = at.select("conv_id", "message").join(p, "message").join(turn_of("parent"), "parent", "left").join(turn_of("root"), "root")
    placed = ranked(ids.select("conv_id", "root", "message", "parent_turn", "root_turn", "depth", "quotes"), ["conv_id", "root", "message"], "_place")
    starts = placed.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_place").alias("_start"))
    placed = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")))
    placed = placed.select("message", "parent_turn", F.col("root_turn").alias("thread_turn"), "depth", "quotes", (F.col("_place") - F.col("_start")).alias("position"))
    deepest = F.coalesce(F.array_max(F.transform("said", lambda x: x["level"])), F.lit(0))
    rendered = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content", F.lit("\n<|end|>"))
    out = at.join(placed, "message")
    return out.select("conv_id", "turn", "role", "message", "parent_turn", "thread_turn", "depth", "quotes", deepest.alias("max_level"), "content", rendered.alias("rendered"), "position")
