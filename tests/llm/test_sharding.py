import zlib
from collections import Counter

from pyspark.sql import functions as F

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from emberloom.llm.sharding import hilbert_index, hilbert_shards, write_shards


def test_curve_visits_every_cell_and_moves_one_step_at_a_time(spark):
    side = range(8)
    cells = spark.createDataFrame([(x, y, z) for x in side for y in side for z in side], "x int, y int, z int")
    at = {r.h: (r.x, r.y, r.z) for r in cells.withColumn("h", hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).collect()}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(511))


def test_law_sizes_and_slots(docs, rows):
    got = hilbert_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_reruns_agree_whatever_the_partitions(docs):
    a = {tuple(r) for r in hilbert_shards(docs).collect()}
    assert a == {tuple(r) for r in hilbert_shards(docs.repartition(7)).collect()}


def test_few_rows_and_none(spark, docs, none):
    assert hilbert_shards(none).count() == 0
    assert sorted(r.shard for r in hilbert_shards(docs.limit(3)).collect())[0] == 0


def test_written_shards_let_readers_pass_over_files(spark, rows, docs, tmp_path):
    many = docs.crossJoin(spark.range(20).withColumnRenamed("id", "_k")).withColumn("text", F.expr("repeat('x', 1 + (doc_id * 37 + _k * 11) % 5000)"))
    write_shards(many, str(tmp_path / "out"), shards=4, files=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == many.count() and sorted(set(many.columns) - set(back.columns)) == []
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in hilbert_shards(many, shards=4).collect()}
    boxes = []
    for f in sorted((tmp_path / "out").rglob("*.parquet")):
        meta = pq.read_metadata(f)
        at = {meta.row_group(0).column(k).path_in_schema: k for k in range(meta.num_columns)}
        least = lambda c: meta.row_group(0).column(at[c]).statistics  # noqa: B023, E731
        boxes.append((least("source").min, least("source").max, least("size").min, least("size").max, meta.num_rows))
    assert len(boxes) >= 12
    # of the files, those whose footer may hold source s1 and a size from 1000 to 2000
    hit = [b for b in boxes if b[0] is not None and b[0] <= "s1" <= b[1] and b[3] >= 1000 and b[2] <= 2000]
    assert 0 < len(hit) <= 0.6 * len(boxes)
