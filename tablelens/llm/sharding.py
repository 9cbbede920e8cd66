"""Sharding by balanced label propagation.

Linked documents, those with equal texts, are moved towards the shard that most of their neighbours are in, as far as the
capacity of that shard allows; few links are cut and shards hold equal numbers of rows. Groups over a share of a shard are dealt into
parts first, so that no group is moved or counted as one. Everything after one pass over the texts works on narrow rows, by
joins and aggregates of the DataFrame API alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.spread import BUCKET_ROWS, attach, read, written

#: Rounds of propagation; a part of a group has at most this share of a shard.
ROUNDS, PART = 4, 1 / 16


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, text_key (the same for equal texts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("text_key"))


def grouped(narrow: DataFrame, rows: int, shards: int) -> DataFrame:
    """Adds part (a linked group, or a piece of one that is too large for one shard) and part_rows."""
    sizes = narrow.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    known = attach(narrow, written(sizes), "text_key", "copies", rows)
    most = max(1, int(rows / shards * PART))
    pieces = F.ceil(F.col("copies") / F.lit(most))
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32"), pieces)
    return known.withColumn("part", F.xxhash64("text_key", piece)).withColumn("linked", F.col("copies") > 1).drop("copies")


def propagate(nodes: DataFrame, rows: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """part, near, part_rows for the linked parts: each round moves parts to where most of their group is, within the quotas.

    A shard takes in no more than it has room for once those that leave it have gone; who may move is drawn by a hash of the part,
    so that a quota needs no order over all movers.
    """
    start = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int")
    at = nodes.where("linked").withColumn("shard", start).groupBy("text_key", "part", "shard").agg(F.count(F.lit(1)).alias("n"))
    capacity = rows / shards
    for turn in range(rounds):
        at = written(at)
        # the neighbours' shard; ties are drawn, so that no shard is favoured. A group has a bounded number of parts
        held = at.groupBy("text_key", "shard").agg(F.sum("n").alias("m"))
        goal = held.groupBy("text_key").agg(F.max_by("shard", F.struct("m", F.xxhash64("text_key", "shard"))).alias("goal"))
        wish = at.join(goal, "text_key")
        load = {r["shard"]: r["n"] for r in at.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        flow = wish.where("shard <> goal").groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()  # at most shards^2 rows
        if not flow:
            break
        leaving, coming = dict.fromkeys(range(shards), 0), dict.fromkeys(range(shards), 0)
        for f in flow:
            leaving[f["shard"]] += f["n"]
            coming[f["goal"]] += f["n"]
        share = {s: min(1.0, max(0.0, capacity - load.get(s, 0) + leaving[s]) / coming[s]) if coming[s] else 1.0 for s in range(shards)}
        allowed = F.element_at(F.create_map(*[F.lit(x) for s in share.items() for x in s]), F.col("goal"))
        drawn = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(1_000_000)) / 1_000_000.0
        moved = F.when(drawn < allowed, F.col("goal")).otherwise(F.col("shard"))
        at = wish.select("text_key", "part", moved.alias("shard"), "n").groupBy("text_key", "part", "shard").agg(F.sum("n").alias("n"))
    best = at.groupBy("part").agg(F.max_by("shard", F.struct("n", F.xxhash64("part", "shard"))).alias("near"), F.sum("n").alias("part_rows"))
    return written(best)


def _ranked(df: DataFrame, group: Column, order: list[Column], bucket: Column) -> DataFrame:
    """Adds rank from 0 without gaps within each group, by bucket and then by ``order``; buckets are counted, not groups sorted."""
    dealt = df.withColumn("_g", group).withColumn("_b", bucket)
    counts = dealt.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("_g").alias("_fg"), F.col("_b").alias("_fb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(*order))
    return (dealt.withColumn("_r", within).join(first, (F.col("_g") == F.col("_fg")) & (F.col("_b") == F.col("_fb")))
            .withColumn("rank", F.col("_first") + F.col("_r") - 1).drop("_g", "_b", "_fg", "_fb", "_first", "_r"))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), linked.

    Shards differ by one row at most, and slots number a shard's rows from 0 without gaps. Of each shard, linked documents come
    first; those beyond its quota, and unlinked ones, fill the shards that have room. Null counts as an empty text of one byte;
    repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are not read.
    """
    narrow = written(describe(docs, id_col, text_col))
    rows = narrow.count()
    nodes = written(grouped(narrow, rows, shards))
    near = propagate(nodes, rows, shards)
    alone = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")
    # parts are bounded, so this join has no hot key; unlinked documents find no part and stay where their hash puts them
    wanted = nodes.join(near, "part", "left").withColumn("near", F.coalesce("near", alone))
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    bucket = F.when(F.col("linked"), F.pmod(F.xxhash64("part"), F.lit(buckets))).otherwise(
        buckets + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    order = [F.col(c) for c in ("part", "doc_id", "text_crc32", "size")]
    placed = written(_ranked(wanted, F.col("near"), order, bucket))
    load = {r["near"]: r["n"] for r in placed.groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    full = F.element_at(F.create_map(*[F.lit(x) for s in quota.items() for x in s]), F.col("near"))
    stay = placed.where(F.col("rank") < full).select("*", F.col("near").alias("shard"), F.col("rank").alias("slot"))
    # what is beyond the quotas is numbered through and fills the shards with room one after another
    over = _ranked(placed.where(F.col("rank") >= full).drop("rank"), F.lit(0), order, bucket)
    begin, ranges = 0, []
    for s in range(shards):
        room = max(0, quota[s] - load.get(s, 0))
        ranges.append((s, begin, begin + room, load.get(s, 0)))
        begin += room
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, low, high, used in ranges:
        inside = (F.col("rank") >= low) & (F.col("rank") < high)
        shard = F.when(inside, F.lit(s)).otherwise(shard)
        slot = F.when(inside, F.col("rank") - low + used).otherwise(slot)
    moved = over.select("*", shard.alias("shard"), slot.alias("slot"))
    out = ["doc_id", "size", "text_crc32", "linked", "shard", "slot"]
    return stay.select(*out).unionByName(moved.select(*out)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
