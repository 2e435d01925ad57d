"""Sharding along a Hilbert curve: files cover small boxes in several metadata dimensions, so that readers can prune them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, whole_row, whole_text

BITS = 8


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of integer coordinates in [0, 2**bits).

    Skilling's transform as two folds over an array: undo the excess work of each bit plane, then Gray-encode and interleave.
    """
    n = len(coordinates)
    assert n * bits <= 62
    x = F.array(*[c.cast("long") for c in coordinates])
    planes = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    axes = F.array(*[F.lit(i) for i in range(n)])

    def axis(x: Column, q: Column, i: Column) -> Column:
        first, own, p = F.element_at(x, 1), F.get(x, i), q - 1
        swap = (first.bitwiseXOR(own)).bitwiseAND(p)
        flip = own.bitwiseAND(q) != 0
        new_first = F.when(flip, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(flip, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == i, new_own).otherwise(v))

    x = F.aggregate(planes, x, lambda x, q: F.aggregate(axes, x, lambda y, i: axis(y, q, i)))
    gray = F.aggregate(
        F.array(*[F.lit(i) for i in range(1, n)]),
        x,
        lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v)),
    )
    last = lambda x: F.element_at(x, -1)
    t = lambda x: F.aggregate(planes, F.lit(0).cast("long"), lambda a, q: F.when(last(x).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
    bit = lambda v, b: F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long"))
    # the undoing mask is the same for every axis; a one-element array binds it once
    return F.element_at(
        F.transform(
            F.array(gray),
            lambda g: F.element_at(
                F.transform(
                    F.array(t(g)),
                    lambda m: F.aggregate(
                        F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]),
                        F.lit(0).cast("long"),
                        lambda a, b: F.aggregate(g, a, lambda a, v: a * 2 + F.call_function("shiftright", v.bitwiseXOR(m), b).bitwiseAND(F.lit(1).cast("long"))),
                    ),
                ),
                1,
            ),
        ),
        1,
    )


def size_step(size: Column, bits: int = BITS) -> Column:
    """A size on a logarithmic scale: 8 steps for each doubling, the last step open."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 8), F.lit((1 << bits) - 1)).cast("long")


def name_step(value: Column, bits: int = BITS) -> Column:
    """A name's place by its hash, null as place 0: rows of one name share it, whatever number of names there is."""
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << bits)))


def placed(docs: DataFrame, shards: int, bits: int, carried: list[Column]) -> DataFrame:
    text = whole_text()
    crc = F.crc32(text.cast("binary")).cast("long")
    size = (F.octet_length(text) + 1).cast("long")
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), name_step(F.col("source"), bits).alias("_s"), name_step(F.col("lang"), bits).alias("_l"), *carried)
    others = [c for c in flat.columns if c not in ("_s", "_l")]
    flat = flat.select(*others, hilbert_index([F.col("_s"), F.col("_l"), size_step(F.col("size"), bits)], bits).alias("curve"))
    order = ["curve", "text_crc32", "doc_id", "size"]
    out = ranked(flat, order).withColumn("shard", F.expr(f"cast(rank * {shards} div all_rows as int)"))
    return out.withColumn("slot", F.expr(f"rank - (cast(shard as bigint) * all_rows + {shards} - 1) div {shards}").cast("long"))


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of every row; law `rows`: counts of the shards differ by one at most.

    Dimensions: source, language and size. Rows are ordered by (curve index, crc32 of the text, doc_id, size), which is total up to rows that are
    alike, and cut into equal runs. The order is spread over range partitions, each numbers its own rows, and the partitions' counts give
    the offsets; no task sees more than a range. Equal texts of one source and language lie side by side. A null text counts as empty,
    null names and ids sort first, an empty table gives no rows, repeated rows take a slot each.
    """
    return placed(docs, shards, bits, []).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16, files: int = 4, bits: int = BITS) -> None:
    """docs with size, curve and slot as Parquet, a folder for each shard (shard=0 ...) with about `files` files, each a run of slots in slot order.

    So a file holds a short piece of the curve: the least and largest source, lang and size in its footer let readers pass over it. Columns named size, curve, slot or shard are
    replaced. All files are written side by side, shards times files of them, whatever the number of rows.
    """
    out = placed(docs, shards, bits, [whole_row(docs, ("size", "curve", "slot", "shard")).alias("row")]).select("row.*", "size", "curve", "slot", "shard")
    out.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
