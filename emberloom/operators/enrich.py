"""Enrichment: weapons with their evidence, canonical actors, and the inferred origin of strikes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gazetteer import ACTORS, COUNTRIES, WEAPONS
from ..functions.text import longest_prefix, none_if_empty, token_set_ratio_column
from ..schema import STRIKES
from .cluster import checkpoint

EVIDENCE, GAZETTEER_CONFIDENCE, FUZZY_LEAST = 60, 0.85, 88.0
ORIGIN_CONFIDENCE = 0.5
#: So many names are sent to all tasks; more are joined by a shuffle.
NAMES_SENT = 50_000


# What stands beside a name, and how an actor's name says whose forces it is.
BEFORE, AFTER = r"(?<![\w-])", r"(?![\w-])"
FORCES_OF = r"(?i)^(?:Military|Police) Forces of (?:the )?(.+)$"


def any_alias(aliases: Iterable[str]) -> str:
    """Any alias, longest first, not inside a longer word; a hyphen belongs to a word."""
    return f"{BEFORE}(?:" + "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a))) + f"){AFTER}"


def one_of_all(aliases: Iterable[str]) -> str:
    """A pattern that finds something where any_alias does: by first letter, so that most places are left after one look."""
    by: dict[str, list[str]] = {}
    for a in sorted(set(aliases)):
        by.setdefault(a[0], []).append(re.escape(a[1:]))
    return f"{BEFORE}(?:" + "|".join(re.escape(c) + "(?:" + "|".join(rest) + ")" for c, rest in by.items()) + f"){AFTER}"


def extract_weapons(events: DataFrame, text: str = "notes") -> DataFrame:
    """(event_id, weapon_key, display_name, category, confidence, method, evidence_span): the first hit of each weapon in a text.

    One pattern of all aliases sends texts without any on their way; each weapon's own pattern is tried on the rest. The evidence is the hit and up to
    60 characters on either side of it, one match, so its length is that of characters whatever the text holds. An empty or null text has no hits.
    """
    every = [a for *_, aliases in WEAPONS for a in aliases]
    t = F.col("t")
    some = events.select(F.col("id").alias("event_id"), F.col(text).alias("t")).filter(t.rlike("(?iuU)" + one_of_all(every)))
    hits = []
    for key, name, category, aliases in WEAPONS:
        hit = F.struct(F.lit(key).alias("weapon_key"), F.lit(name).alias("display_name"), F.lit(category).alias("category"), F.lit(GAZETTEER_CONFIDENCE).alias("confidence"), F.lit("gazetteer").alias("method"))
        hits.append(F.when(t.rlike("(?iuU)" + any_alias(aliases)), hit))
    found = some.select("event_id", "t", F.explode(F.array_compact(F.array(*hits))).alias("w"))
    # where the hit is, as a number of characters, from what stands before it
    patterns = F.create_map(*[x for key, _, _, aliases in WEAPONS for x in (F.lit(key), F.lit("(?iuUs)^(.*?)(" + any_alias(aliases) + ")(.*)$"))])
    own = F.element_at(patterns, F.col("w.weapon_key"))
    found = found.withColumn("p", own)
    before, hit, after = (F.call_function("regexp_extract", t, F.col("p"), F.lit(k)) for k in (1, 2, 3))
    span = F.concat(F.right(before, F.lit(EVIDENCE)), hit, F.left(after, F.lit(EVIDENCE)))
    return found.select("event_id", "w.*", F.regexp_replace(span, r"(?U)^\s+|\s+$", "").alias("evidence_span"))


def actor_vocabulary(events: DataFrame) -> DataFrame:
    """Distinct names that the curated feed uses."""
    curated = events.filter("source = 'acled'")
    names = curated.select(F.col("actor_a").alias("name")).union(curated.select("actor_b"))
    return names.filter("name is not null").distinct()


def canonical_actors(names: DataFrame, vocabulary: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """(name, canonical) for each distinct name: its alias, else the most similar vocabulary name, else null.

    Only distinct names without an alias are compared, and of the vocabulary only what can reach the limit: names meet on pairs of letters of their words (a blank before and after
    each), and of one side only the rarest pairs count. Why none is lost, for a share s = least / 100 and a name of m characters, its words once and joined by blanks:

    * A score of s from both names' words needs a common subsequence of s (m + n) / 2 characters, so n <= m (2 - s) / s, and at most (1 - s) (m + n) <= 2 m (1 - s) / s insertions and deletions.
      Each takes at most two of the name's pairs, whatever the order of the words, as these pairs don't depend on it.
    * A score of s from the common words against one of the names needs the other words of that name to have at most 2 (1 - s) / s of its characters, and so of its pairs.

    So of all but floor(4 m (1 - s) / s) of one name's pairs each is also in the other name, for one of the two names at least, and that name's rarest pairs, one more than that
    number, hold one of them. Frequent pairs, which nearly all names have, are among these for short names only.
    """
    distinct = names.select("name").filter("name is not null").distinct()
    table = F.create_map(*[F.lit(x) for pair in ACTORS.items() for x in pair])
    told = distinct.withColumn("alias", F.element_at(table, F.lower(F.trim("name"))))
    words = F.array_sort(F.array_distinct(F.filter(F.split("name", r"(?U)\s+"), lambda w: w != "")))
    joined = F.array_join(words, " ")
    letters = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), k, 2)))))
    pairs = lambda df: df.select("name", F.length(joined).alias("m"), F.explode(letters).alias("pair"))
    right = checkpoint(pairs(vocabulary.select("name").filter("name is not null").distinct()))
    if right.isEmpty():  # no name that another could be like
        return told.select("name", F.col("alias").alias("canonical"))
    left = checkpoint(pairs(told.filter("alias is null").select("name")))
    often = left.select("pair").unionAll(right.select("pair")).groupBy("pair").agg(F.count("*").alias("often"))
    share = least / 100
    place = F.row_number().over(Window.partitionBy("name").orderBy("often", "pair"))
    rare = lambda df: df.join(often, "pair").withColumn("place", place).filter(F.col("place") <= F.floor(4 * F.col("m") * (1 - share) / share + 1e-9) + 1)
    meet = lambda a, b: a.select("name", "pair").join(b.select(F.col("name").alias("known"), "pair"), "pair").select("name", "known")
    scored = meet(rare(left), right).unionAll(meet(left, rare(right))).distinct()
    scored = scored.withColumn("score", token_set_ratio_column("name", "known")).filter(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.min_by("known", F.struct(-F.col("score"), F.col("known"))).alias("fuzzy"))
    return told.join(best, "name", "left").select("name", F.coalesce("alias", "fuzzy").alias("canonical"))


def canonicalize(events: DataFrame, least: float = FUZZY_LEAST, vocabulary: DataFrame | None = None) -> DataFrame:
    """events with actor_a_canonical and actor_b_canonical: curated feeds keep their names, others get the canonical one, by a vocabulary (name) or that of the events themselves."""
    vocabulary = actor_vocabulary(events) if vocabulary is None else vocabulary
    names = events.select(F.col("actor_a").alias("name")).unionAll(events.select("actor_b"))
    known = checkpoint(canonical_actors(names, vocabulary, least))  # a row a name, read for each side
    # where a few names are those of all reports, a shuffle by name would leave a few tasks with everything
    known = F.broadcast(known) if known.count() <= NAMES_SENT else known
    curated = F.col("source").isin("acled", "ucdp")
    out = events
    for side in ("actor_a", "actor_b"):
        k = known.select(F.col("name").alias(side), F.col("canonical").alias("_c"))
        out = out.join(k, side, "left").withColumn(f"{side}_canonical", F.when(curated, F.col(side)).otherwise(F.col("_c"))).drop("_c")
    return out


def state_country(actor: Column) -> Column:
    """The country whose forces an actor's name says it is: the longest run of words, from the first, that names one."""
    plain = F.trim(F.regexp_replace(actor, r"\([^)]*\)", " "))
    after = F.regexp_extract(plain, FORCES_OF, 1)
    words = F.filter(F.split(F.trim(after), r"\s+"), lambda w: w != "")
    names = F.create_map(*[F.lit(x) for c in COUNTRIES for x in (c.lower(), c)])
    return longest_prefix(F.transform(words, lambda w: F.lower(w)), names)


def infer_origin(events: DataFrame) -> DataFrame:
    """events with origin_country, origin_lat, origin_lon, origin_precision, origin_method, origin_confidence: of strikes by another country's forces, else nulls."""
    actor = F.coalesce(none_if_empty(F.col("actor_a_canonical")), F.col("actor_a")) if "actor_a_canonical" in events.columns else F.col("actor_a")
    country = state_country(actor)
    where = F.create_map(*[x for c, (a, b) in COUNTRIES.items() for x in (F.lit(c), F.array(F.lit(float(a)), F.lit(float(b))))])
    target = none_if_empty(F.lower(F.trim("country")))
    foreign = F.coalesce(F.col("category").isin(*STRIKES) & (F.lower(country) != target), F.lit(False))
    out = events.withColumn("origin_country", F.when(foreign, country))
    at = F.element_at(where, F.col("origin_country"))
    some = F.col("origin_country").isNotNull()
    return out.withColumns(
        {
            "origin_lat": F.get(at, 0),
            "origin_lon": F.get(at, 1),
            "origin_precision": F.when(some, "country"),
            "origin_method": F.when(some, "actor_country_inference"),
            "origin_confidence": F.when(some, ORIGIN_CONFIDENCE),
        }
    )
