"""Ways to keep hot keys off single tasks: joins, numbering and intermediate tables whose parts stay bounded."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.sources.tables import shared_folder

#: A key with more than one row in so many is hot. There can be no more hot keys than this number.
HOT_SHARE = 2_000
#: Tables of up to so many rows are joined as they are: whatever their keys, a task holds no more rows.
PLAIN_ROWS = 20_000
#: Rows that one bucket of a numbering holds on average.
BUCKET_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, side: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Left join of ``df`` with ``side`` (one row per key) on ``key``; ``weight`` tells how many rows of df have the key.

    Keys with over rows/HOT_SHARE rows are at most HOT_SHARE in number, so they are broadcast; the rest is a shuffle join in
    which no key is larger than that share. Rows already served get a key of their own there, and so spread evenly.
    """
    if rows <= PLAIN_ROWS:
        return df.join(side, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], *[c for c in side.columns if c != key])
    limit = max(1, rows // HOT_SHARE)
    values = [c for c in side.columns if c != key]
    hot = side.where(F.col(weight) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    cold = side.where(F.col(weight) <= limit).select(
        F.col(key).alias("_ck"), F.xxhash64(key).alias("_deal"), F.struct(*values).alias("_cold"))
    served = df.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    deal = F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(*df.columns))
    both = (served.withColumn("_s", deal)
            .join(cold, (F.col("_s") == F.col("_deal")) & (F.col(key) == F.col("_ck")), "left"))
    pick = [F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values]
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *pick)


def numbered(df: DataFrame, group: str, tie: list[str], rows: int, name: str = "rank") -> DataFrame:
    """Adds a number from 0 without gaps within each group, in no special order of the rows.

    Rows are dealt into buckets by the hash of ``tie``; bucket counts give each bucket's first number, so that a group of any
    size is numbered by many tasks.
    """
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)))
    counts = dealt.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_fb"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*tie))
    return (dealt.withColumn("_r", within)
            .join(first, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_fb")))
            .withColumn(name, F.col("_first") + F.col("_r") - 1)
            .drop("_b", "_g", "_fb", "_first", "_r"))
