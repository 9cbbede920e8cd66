"""Summaries of columns that tasks keep while they scan and that merge: frequent values with error bounds, and the smallest values.

They hold a bounded number of values per column and task, so neither the shuffle nor any task sees all distinct values of a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.config import DEFAULT, LensConfig
from tablelens.sources.tables import cut_lineage


class Frequent:
    """Misra-Gries counters of one column: every count is too low by at most ``error``, and what is not counted occurs no more often."""

    def __init__(self, size: int):
        self.size, self.error, self.parts, self.waiting = size, 0, [], 0

    def add(self, values: pa.Array) -> None:
        found = values.drop_null().value_counts()
        self.parts.append(pa.table({"value": found.field("values").cast(pa.large_string()), "n": found.field("counts").cast(pa.int64())}))
        self.waiting += len(found)
        if self.waiting > 4 * self.size:
            self.merge()

    def merge(self) -> pa.Table:
        all_ = pa.concat_tables(self.parts or [pa.table({"value": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})])
        if len(self.parts) > 1:
            all_ = all_.group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"])
        n = all_.column("n").to_numpy()
        if len(n) > self.size:  # what the counter after the last kept one has, all lose
            over = int(-np.partition(-n, self.size)[self.size])
            all_ = all_.set_column(1, "n", pa.array(n - over)).filter(pa.array(n > over))
            self.error += over
        self.parts, self.waiting = [all_], all_.num_rows
        return all_


def _texts(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)])


def _long(values: DataFrame) -> DataFrame:
    """ord, value, h1, h2 for every value that is not null; the hashes stand for the value where it may be long."""
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.col(c).alias("value")) for i, c in enumerate(values.columns)])
    rows = values.select(F.inline(each)).where("value IS NOT NULL")
    return rows.select("ord", "value", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(23), "value").alias("h2"))


def frequent_values(values: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """ord, value, n (lower bounds), and one row per column without value whose n is the sum of the errors of all tasks."""
    size, width = cfg.frequent_counters, len(values.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Frequent(size) for _ in range(width)]
        for batch in batches:
            for column, counters in zip(batch.columns, kept):
                counters.add(column)
        for i, counters in enumerate(kept):
            merged = counters.merge()
            value = pa.concat_arrays([*merged.column("value").cast(pa.string()).chunks, pa.array([None], pa.string())])
            n = np.append(merged.column("n").to_numpy(), counters.error)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i), pa.int32()), value, pa.array(n)], ["ord", "value", "n"])

    return values.mapInArrow(count, "ord int, value string, n bigint").groupBy("ord", "value").agg(F.sum("n").alias("n"))


def _top(rows: DataFrame, n: int, function: str = "row_number") -> DataFrame:
    ranked = rows.selectExpr("*", f"{function}() OVER (PARTITION BY ord ORDER BY n DESC{', value' if function == 'row_number' else ''}) AS rank")
    return ranked.where(F.col("rank") <= n)


def most_frequent(df: DataFrame, columns: list[Column], cfg: LensConfig = DEFAULT) -> DataFrame:
    """The top_n most frequent values of columns, as text: ord, rank, value, n; ties by the text.

    One scan counts columns with few values exactly. Where tasks had to drop counters, the bound on what they dropped tells whether the
    leading candidates hold all of the top; these are then counted once more. Where it does not, values are counted by 128-bit hashes.
    """
    values = _texts(df, columns)
    found = cut_lineage(frequent_values(values, cfg))
    error = {r["ord"]: r["n"] for r in found.where("value IS NULL").collect()}
    counted = found.where("value IS NOT NULL")
    exact = [i for i in range(len(columns)) if not error.get(i)]
    parts = [_top(counted.where(F.col("ord").isin(exact)), cfg.top_n)] if exact else []
    unsure = []
    for i in (i for i in range(len(columns)) if error.get(i)):
        lead = counted.where(F.col("ord") == i).orderBy(F.desc("n")).limit(cfg.frequent_counters + 1)
        n = [r["n"] for r in lead.select("n").collect()]
        tenth = n[cfg.top_n - 1] if len(n) >= cfg.top_n else 0
        outside = error[i] + (n[cfg.frequent_counters] if len(n) > cfg.frequent_counters else 0)
        if tenth > outside:  # whatever is no candidate occurs less often than the last of the top
            parts.append(_top(_recounted(values, i, _hashed(lead.limit(cfg.frequent_counters))), cfg.top_n))
        else:
            unsure.append(i)
    parts += [_top_by_hash(values, i, cfg) for i in unsure]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("ord", F.col("rank").cast("bigint").alias("rank"), "value", "n")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("value").alias("k1"), F.xxhash64(F.lit(23), "value").alias("k2"))


def _recounted(values: DataFrame, i: int, candidates: DataFrame) -> DataFrame:
    """ord, value, n of the values of a column whose hashes are among the candidates (k1, k2), of which there is a bounded number."""
    rows = _long(values.select(f"c{i}")).join(F.broadcast(candidates), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("ord"), "value", "n")


def _top_by_hash(values: DataFrame, i: int, cfg: LensConfig) -> DataFrame:
    """The top of a column with many values: counts by hash tell the count that the last of the top has, and texts break ties at it."""
    counts = cut_lineage(_long(values.select(f"c{i}")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    last = counts.orderBy(F.desc("n")).limit(cfg.top_n).agg(F.min("n")).first()[0]
    keys = counts.where(F.col("n") >= last).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n")
    above, level = keys.where(F.col("n") > last), keys.where(F.col("n") == last)
    if level.count() <= cfg.frequent_counters:
        return _top(_recounted(values, i, keys.drop("n")), cfg.top_n)
    sure = cut_lineage(_recounted(values, i, above.drop("n")))
    wanted, size = cfg.top_n - sure.count(), cfg.frequent_counters
    while True:  # very many values tie: among the first in order of text, enough of them are found soon
        first = cut_lineage(smallest(values.select(F.col(f"c{i}").alias("value")), size))
        ties = cut_lineage(first.join(level, (F.xxhash64("value") == F.col("k1")) & (F.xxhash64(F.lit(23), "value") == F.col("k2")))
                           .orderBy("value").limit(wanted).select(F.lit(i).alias("ord"), "value", "n"))
        if ties.count() == wanted or first.count() < size:
            return _top(sure.unionByName(ties), cfg.top_n)
        size *= 16


def smallest(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """The ``size`` distinct rows with the smallest value, or the smallest ``by`` and value; each task hands on no more than these."""
    order = ([by] if by else []) + ["value"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).select(order)
            part = part.filter(pc.is_valid(part.column("value")))
            if kept is not None and kept.num_rows >= size:
                part = part.filter(pc.less_equal(part.column(order[0]), kept.column(order[0])[-1]))
            if part.num_rows:
                part = part if kept is None else pa.concat_tables([kept, part])
                kept = part.group_by(order).aggregate([]).sort_by([(c, "ascending") for c in order]).slice(0, size)
        if kept is not None:
            yield from kept.to_batches()

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order)
    return rows.select(order).mapInArrow(keep, schema).distinct().orderBy(*order).limit(size)


def smallest_hashes(df: DataFrame, columns: list[Column], size: int) -> DataFrame:
    """ord, place, value: of each column the ``size`` distinct values (as text) with the smallest hash, from one scan."""
    texts = _texts(df, columns)
    hashed = texts.select("*", *[F.xxhash64(c).alias(f"h{c}") for c in texts.columns])
    width = len(columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table | None] = [None] * width
        for batch in batches:
            for i in range(width):
                value, h, table = batch.column(i), batch.column(width + i), kept[i]
                wanted = pc.is_valid(value)
                if table is not None and table.num_rows >= size:
                    wanted = pc.and_(wanted, pc.less_equal(h, table.column("h")[-1]))
                part = pa.table({"h": h, "value": value}).filter(wanted)
                if part.num_rows:
                    part = part if table is None else pa.concat_tables([table, part])
                    kept[i] = part.group_by(["h", "value"]).aggregate([]).sort_by([("h", "ascending"), ("value", "ascending")]).slice(0, size)
        for i, table in enumerate(kept):
            if table is not None:
                for batch in table.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, i), pa.int32()), *batch.columns], ["ord", "h", "value"])

    rows = hashed.mapInArrow(keep, "ord int, h bigint, value string").distinct()
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("ord").orderBy("h", "value")))
    return placed.where(F.col("place") <= size).select("ord", "place", "value")
