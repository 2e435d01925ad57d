"""A training corpus from raw documents: each stage takes the documents that the one before it left, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.llm import classifier, mixing, pieces, simhash, suffix_dedup
from emberloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.score_documents(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id, null last; of its rows that share id and text, one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d")  # no id is no number
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    rows = docs.select(*COLUMNS, key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_x"), F.xxhash64(F.struct(*others)).alias("_o"))
    # which row of an id and text stays is decided without texts, and these meet the answer as they come, unsorted
    each = rows.select("_d", "_x", "_o", F.struct(*others).alias("_s")).groupBy("_d", "_x", "_o").agg(F.min("_s").alias("_s"), F.count("*").alias("_n"))
    kept = simhash.representatives(docs).select(key, F.col("x").alias("_x"))
    chosen = each.join(kept, ["_d", "_x"], "left_semi").groupBy("_d", "_x").agg(F.min_by(F.struct("_o", "_n"), "_s").alias("_c")).select("_d", "_x", "_c.*")
    chosen = stored(chosen, "kept-documents")
    of = lambda which: rows.join(chosen.filter(which).hint("shuffle_hash"), ["_d", "_x", "_o"]).select(*COLUMNS)
    if not chosen.filter("_n > 1").limit(1).count():
        return of("_n = 1")
    return of("_n = 1").unionAll(of("_n > 1").dropDuplicates())


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier go from the texts; a character that lost some of its bytes goes as a whole. All documents stay."""
    cleaned = suffix_dedup.clean_documents(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.expand(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text."""
    return pieces.encode_documents(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("mixing sources to target weights", mixture), ("SentencePiece encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, boosted models and keyed merges aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
