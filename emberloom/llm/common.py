"""Small pieces that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts of the operators define it: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text that isn't null."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and where it is unset on a single machine (tests) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def few(df: DataFrame) -> DataFrame:
    """df in no more partitions than four for each core of the cluster: narrow rows that are written and read again don't need a file for each shuffle partition."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint; for narrow rows."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder; for rows that are read again by column.

    The folder keeps the table until the cluster clears it, so that a lost executor costs no recomputation.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns but some as one struct, so that no name of theirs meets one that an operator uses; what isn't selected of it in the end isn't read."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 0, in the given order of columns, and all_rows.

    Rows are spread over range partitions, each numbers its own, and the partitions' counts give the offsets: no task sees more than a
    range. The order should be total up to rows that are alike, else a hot key isn't split.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").count()  # as many rows as there are partitions: one task may sum them up, and they may be broadcast
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"), F.sum("count").over(Window.partitionBy()).alias("all_rows"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")
