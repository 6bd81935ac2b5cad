"""Session helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import materialize, shared_dir

__all__ = ["components", "hot_ones", "materialize", "shared_dir", "split_by_ids", "table"]

#: A key is hot from this share of all rows on, so there are fewer than HOT hot keys.
HOT = 1024
#: Places that a hot key's rows are dealt to.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_ones(counted: DataFrame, rows: int) -> DataFrame:
    """The rows of ``counted`` (one per key, with ``n``) whose key has more than a HOT-th part of all
    rows: fewer than HOT by arithmetic, so they are broadcast."""
    return F.broadcast(counted.where(F.col("n") > max(HOT, rows // HOT)))


BITS = 22


def split_by_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may be among ``ids``, and those that certainly are not.

    A bitmap of 2**BITS hashed ids tells them apart (half a megabyte, whatever the sizes), so that
    texts which no later join needs are not dealt. Rows with a null id are in the second part.
    """
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("long")), 64 - BITS)
    bits = (
        ids.select(slot(column).alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
        .collect()  # 2**BITS bits at most
    )
    table = df.sparkSession.createDataFrame([(r[0], r[1]) for r in bits], "_part long, _bits binary")
    at = F.bitmap_bit_position(slot(column))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    bit = (byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
    joined = df.withColumn("_part", F.when(F.col(column).isNotNull(), F.bitmap_bucket_number(slot(column)))).join(F.broadcast(table), "_part", "left")
    joined = joined.withColumn("_listed", F.coalesce(bit == 1, F.lit(False)))
    return joined.where("_listed").select(*df.columns), joined.where("not _listed").select(*df.columns)
