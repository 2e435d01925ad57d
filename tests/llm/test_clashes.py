"""Every operator takes tables whose other columns have the names that it uses inside."""

import pytest
from pyspark.sql import functions as F

from emberloom.llm import chat, classifier, cover_tree, html_text, mixing, pieces, quality_rules, sharding, simhash, suffix_dedup

NAMES = (
    "row of size draw slice n passes extra _s _n _l _h _p _size _sl _quota _source_size _words _copies _target _draw bound upto quality _d _f f score held_out predicted t d c h tie marks rest run salt "
    "start clean _c0 _c1 _q_t _q_w _q_n _q_h _q_kept _q__t n_words fp x variant root node component_id shard slot curve law rank all_rows _part _before text_crc32 ids lossless message parent said lines "
    "depth position quotes unit rep cell part tree pair cosine far n_chars url"
).split()
DOCS = [(1, "one two three four five " * 30, "en", "a"), (2, None, None, None), (None, "x", "de", "b"), (4, "one two three four five " * 30, "en", "a")]


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def kept(df, added=()):
    """Other columns that aren't replaced keep their values."""
    rows = df.collect()
    assert len(rows) == 4
    for n in NAMES:
        if n in df.columns and n not in added:
            assert {r[n] for r in rows} == {f"own {n}"}


def test_mixing(wide):
    mixed = mixing.mix(wide)
    kept(mixed, mixing.ADDED)
    assert set(wide.columns) <= set(mixed.columns)
    out = mixing.expand(mixed)
    assert set(out.columns) == set(wide.columns) - set(mixing.ADDED)


def test_sharding(wide, spark, tmp_path):
    assert sharding.hilbert_shards(wide).count() == 4
    sharding.write_shards(wide, str(tmp_path / "out"))
    kept(spark.read.parquet(str(tmp_path / "out")), ("size", "curve", "slot", "shard"))


def test_quality_rules(wide):
    out = quality_rules.apply_rules(wide.drop("n_words"))
    kept(out, ("kept", "n_words"))
    assert set(wide.columns) <= set(out.columns)
    assert quality_rules.apply_rules(wide).schema["n_words"].dataType.simpleString() == "bigint"


def test_suffix_dedup(wide):
    kept(suffix_dedup.clean_documents(wide))
    assert suffix_dedup.dedup(wide).count() == 4


def test_simhash_and_pieces(wide):
    assert simhash.near_duplicates(wide).count() == 4 and simhash.representatives(wide).count() == 3
    assert pieces.encode_documents(wide).filter("lossless").count() == 4


def test_classifier(wide, spark):
    labels = spark.createDataFrame([(k, k % 2, "z") for k in range(40)], "doc_id long, quality int, f string")
    kept(classifier.score_documents(wide, labels), ("held_out", "score", "predicted"))


def test_html(wide):
    kept(html_text.extract_pages(wide.withColumnRenamed("lang", "html").drop("text")), ("n_chars",))


def test_chat(wide):
    turns = wide.withColumnsRenamed({"doc_id": "conv_id", "source": "role"}).withColumn("turn", F.lit(1))
    assert chat.link_replies(turns).count() == 4


def test_cover_tree(wide):
    vectors = wide.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    assert cover_tree.near_duplicates(vectors).count() == 4
