"""Exact quantiles (linear interpolation) by radix selection: bounded memory and at most five passes, whatever the distribution.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here doubles are taken in the order of a 64-bit image of theirs:
values are counted by its leading bits, the bucket that holds a wanted rank is found, and only that bucket is counted by the bits that
follow. Columns are counted side by side as they stand, each in arrays of a fixed size. Of groups, only those of very many rows are counted
like this; the rows of the others are sorted by group and value.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.config import DEFAULT, LensConfig
from tablelens.functions.text import col, ident
from tablelens.sources.tables import broadcast_if_small, cut_lineage

DIGIT_BITS = 16
FINE_BITS = 14           # of the image that columns are counted by after the first pass
BLOCK_VALUES = 1 << 20   # values that are counted at once
HELD_ROWS = 1 << 18      # counted rows that a task holds before it hands them on


def image(v: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of doubles (without NaN and -0): exponent and fraction as IEEE 754 has them, signed like the value."""
    bits = np.ascontiguousarray(v).view(np.int64)
    return np.where(bits >= 0, bits, -(bits & np.int64(2**63 - 1)))


def from_image(x: int) -> float:
    """The double whose image this is."""
    return float(np.int64(x if x >= 0 else -x - 2**63).view(np.float64))


def ranks(probs: list[float]) -> str:
    """SQL for an array of the ranks (from 0) between which the quantiles of n values lie."""
    return "array(" + ", ".join(f"CAST({f}({p}D * (n - 1)) AS BIGINT)" for p in probs for f in ("floor", "ceil")) + ")"


def _pick(counts: DataFrame, keys: list[str], first: str, *more: str) -> DataFrame:
    """Of counted buckets those that hold a wanted rank: keys, target, rank (within the bucket), prefix, lo, hi, and ``more`` columns.

    ``first`` is the array of (target, rank) that is wanted among a group's buckets.
    """
    before = Window.partitionBy(*[col(k) for k in keys], *(["parent"] if "parent" in counts.columns else [])).orderBy("prefix")
    placed = counts.withColumn("_upto", F.sum("n").over(before)).withColumn("_wanted", F.expr(first))
    inside = F.filter("_wanted", lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("n")))
    each = placed.withColumn("_w", F.explode(inside))
    return each.select(*[col(k) for k in keys], F.col("_w.target").alias("target"),
                       (F.col("_w.rank") - F.col("_upto") + F.col("n")).alias("rank"), "prefix", "lo", "hi", *more)


def _counted(rows: DataFrame, by: list[str], digit: int) -> DataFrame:
    """by, prefix (of the image, ``digit`` times DIGIT_BITS long), n, lo, hi; counts of a task are combined before they are shuffled."""
    shift, names = 64 - DIGIT_BITS * digit, [*by, "prefix", "n", "lo", "hi"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).group_by([*by, "prefix"]).aggregate([("n", "sum"), ("lo", "min"), ("hi", "max")])
        return whole.rename_columns([c.removesuffix("_sum").removesuffix("_min").removesuffix("_max") if c not in by else c
                                     for c in whole.column_names]).select(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            v = table.column("v").to_numpy() + 0.0
            table = table.select(by).append_column("prefix", pa.array(image(v) >> shift)).append_column("n", pa.array(np.ones(len(v), np.int64)))
            parts.append(merged([table.append_column("lo", pa.array(v)).append_column("hi", pa.array(v))]))
            size += parts[-1].num_rows
            if size > HELD_ROWS:
                parts = [merged(parts)]
                size = parts[0].num_rows
                if size > HELD_ROWS // 2:  # hardly anything combines: what is counted goes to the shuffle, so that neither memory nor merges grow
                    yield from parts[0].to_batches()
                    parts, size = [], 0
        if parts:
            yield from merged(parts).to_batches()

    schema = ", ".join(f"{ident(c)} {rows.schema[c].dataType.simpleString()}" for c in by) + ", prefix bigint, n bigint, lo double, hi double"
    found = rows.select(*[col(c) for c in by], "v").mapInArrow(count, schema)
    return found.groupBy(*[col(c) for c in by], "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _by_radix(rows: DataFrame, keys: list[str], probs: list[float], cfg: LensConfig) -> DataFrame:
    """Quantiles of groups of any size: keys, n, q."""
    by = [col(k) for k in keys]
    counts = cut_lineage(_counted(rows, keys, 1))
    total = counts.withColumn("n_all", F.sum("n").over(Window.partitionBy(*by)))
    wanted = f"transform({ranks(probs).replace('(n - 1)', '(n_all - 1)')}, (r, i) -> named_struct('target', i, 'rank', r))"
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    open_, done = _pick(total, keys, wanted), []
    for digit in range(2, 64 // DIGIT_BITS + 1):
        open_ = cut_lineage(open_)
        done.append(open_.where("lo = hi"))
        open_ = open_.where("lo < hi")
        targets = open_.groupBy(*by, "prefix", "lo", "hi").agg(F.collect_list(F.struct("target", "rank")).alias("_targets"))
        targets = targets.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("prefix").alias("parent"), "lo", "hi", "_targets")
        n = targets.count()
        if not n:
            open_ = None
            break
        on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        within = F.col("v").between(F.col("lo"), F.col("hi"))  # buckets are stretches of the order
        inner = rows.join(broadcast_if_small(targets.drop("_targets"), n, cfg), [*on, within]).select(*by, "parent", "v")
        finer = _counted(inner, [*keys, "parent"], digit)
        wanted_in = targets.drop("lo", "hi").withColumnRenamed("parent", "_parent")
        mine = finer.join(broadcast_if_small(wanted_in, n, cfg),
                          [*on, F.col("parent") == F.col("_parent")]).drop("_parent", *[f"_k{i}" for i in range(len(keys))])
        open_ = _pick(mine, keys, "_targets")
    if open_ is not None:
        done.append(open_)  # all bits are known, so lo = hi
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    ends = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("target", "lo"))).alias("_v"))
    named = ends.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v")
    joined = sizes.join(named, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return joined.select(*by, "n", _interpolated(probs))


def _interpolated(probs: list[float]) -> Column:
    """q, from the values _v of the ranks between which the quantiles of n values lie."""
    at = [f"{p}D * (n - 1)" for p in probs]
    q = [f"CASE WHEN floor({a}) = ceil({a}) THEN _v[{2 * i}] "
         f"ELSE (ceil({a}) - ({a})) * _v[{2 * i}] + (({a}) - floor({a})) * _v[{2 * i + 1}] END" for i, a in enumerate(at)]
    return F.expr(f"array({', '.join(q)})").alias("q")


def _by_sorting(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of groups none of which is too large for a task: keys, n, q. Rows are shuffled once and sorted by group and value."""
    by = [col(k) for k in keys]
    group = Window.partitionBy(*by)
    placed = rows.select(*by, (F.col("v") + F.lit(0.0)).alias("v")).select(
        *by, "v", F.row_number().over(group.orderBy("v")).alias("_at"), F.count(F.lit(1)).over(group).alias("n"))
    wanted = F.transform(F.expr(ranks(probs)), lambda r: r + 1)
    near = placed.where(F.array_contains(wanted, F.col("_at").cast("bigint")))
    ends = near.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("bigint").alias("at"), "v"))).alias("_m"))
    return ends.withColumn("_v", F.transform(wanted, lambda r: F.col("_m")[r])).select(*by, "n", _interpolated(probs))


def selected(values: DataFrame, keys: list[str], probs: list[float], cfg: LensConfig = DEFAULT) -> DataFrame:
    """Exact quantiles of v per group: keys, n, q (an array in the order of probs); NaN and null do not count.

    A group without values has no row. Infinite values are the largest and smallest. -0 is 0. Groups of more than ``cfg.sorted_group_rows``
    rows, of which there are few, are told by their size and go by radix selection; all others are sorted.
    """
    rows = values.where("v IS NOT NULL AND NOT isnan(v)")
    sizes = rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > cfg.sorted_group_rows)
    large = cut_lineage(sizes.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    n = large.count()
    if not n:
        return _by_sorting(rows, keys, probs)
    on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    sent = broadcast_if_small(large, n, cfg)
    return _by_sorting(rows.join(sent, on, "left_anti"), keys, probs).unionByName(
        _by_radix(rows.join(sent, on, "left_semi"), keys, probs, cfg))


WHOLE = tuple(int(image(np.array([e]))[0]) for e in (-np.inf, np.inf))


def _binned(values: DataFrame, spans: dict[int, list[tuple[int, int]]], bits: int) -> DataFrame:
    """ord, parent, prefix, n, lo, hi: the values of columns within spans of images, counted by the leading bits of their distance from its start.

    A task counts every span in arrays of 2^bits places. lo and hi are the images of the extremes of a place.
    """
    size = 1 << bits
    shift = {(i, k): max(0, (hi - lo).bit_length() - bits) for i, parts in spans.items() for k, (lo, hi) in enumerate(parts)}
    schema = "ord int, parent int, prefix bigint, n bigint, lo bigint, hi bigint"

    def add(found: dict, table: pa.Table) -> None:
        for i, parts in spans.items():
            v = table.column(f"v{i}").to_numpy()
            x = image(v[~np.isnan(v)] + 0.0)
            for k, (lo, hi) in enumerate(parts):
                mine = x if (lo, hi) == WHOLE else x[(x >= lo) & (x <= hi)]
                if not len(mine):
                    continue
                if (i, k) not in found:
                    found[i, k] = np.zeros(size, np.int64), np.full(size, WHOLE[1]), np.full(size, WHOLE[0])
                n, low, high = found[i, k]
                # unsigned, since the distance of two images may pass 63 bits
                at = ((mine.view(np.uint64) - np.uint64(lo % 2**64)) >> np.uint64(shift[i, k])).astype(np.int64)
                n += np.bincount(at, minlength=size)
                np.minimum.at(low, at, mine)
                np.maximum.at(high, at, mine)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting, rows = {}, [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows * batch.num_columns >= BLOCK_VALUES:
                add(found, pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if waiting:
            add(found, pa.Table.from_batches(waiting))
        for (i, k), (n, low, high) in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(np.full(len(at), k), pa.int32()),
                                              pa.array(at), pa.array(n[at]), pa.array(low[at]), pa.array(high[at])],
                                             ["ord", "parent", "prefix", "n", "lo", "hi"])

    found = values.select(*[f"v{i}" for i in spans]).mapInArrow(count, schema)
    return found.groupBy("ord", "parent", "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _of_columns(values: DataFrame, probs: list[float], ends: dict[int, tuple[float, float]]) -> dict[int, list[float]]:
    """Quantiles of the columns v0, v1, ... that hold values; a few rows per column reach the driver after every pass.

    The first pass divides what lies between the known ends of a column, else the whole line.
    """
    spark = values.sparkSession
    first = {i: tuple(int(x) for x in image(np.array(e) + 0.0)) for i, e in ends.items()}
    counts = _binned(values, {i: [first.get(i, WHOLE)] for i in range(len(values.columns))}, DIGIT_BITS)
    total = counts.withColumn("n_all", F.sum("n").over(Window.partitionBy("ord")))
    wanted = f"transform({ranks(probs).replace('(n - 1)', '(n_all - 1)')}, (r, i) -> named_struct('target', i, 'rank', r))"
    rows = _pick(total, ["ord"], wanted, "n_all", "n").collect()
    sizes = {r["ord"]: r["n_all"] for r in rows}
    known: dict[tuple[int, int], float] = {}
    while True:
        at_end = {(r["ord"], r["target"]): r["lo"] if r["rank"] == 0 else r["hi"] for r in rows
                  if r["lo"] == r["hi"] or r["rank"] in (0, r["n"] - 1)}  # the extremes of a place are values
        known |= {k: from_image(x) for k, x in at_end.items()}
        spans: dict[int, list[tuple[int, int]]] = {}
        asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in (r for r in rows if (r["ord"], r["target"]) not in at_end):
            mine = spans.setdefault(r["ord"], [])
            if (r["lo"], r["hi"]) not in mine:
                mine.append((r["lo"], r["hi"]))
            asked.setdefault((r["ord"], mine.index((r["lo"], r["hi"]))), []).append((r["target"], r["rank"]))
        if not spans:
            break
        ask = spark.createDataFrame([(*k, v) for k, v in asked.items()], "ord int, parent int, _asked array<struct<target: int, rank: bigint>>")
        finer = _binned(values, spans, FINE_BITS).join(F.broadcast(ask), ["ord", "parent"])
        rows = _pick(finer, ["ord"], "_asked", "n").collect()
    out = {}
    for i, n in sizes.items():
        at = [p * (n - 1) for p in probs]
        ends = [(known[i, 2 * k], known[i, 2 * k + 1]) for k in range(len(probs))]
        out[i] = [lo if floor(a) == ceil(a) else (ceil(a) - a) * lo + (a - floor(a)) * hi for a, (lo, hi) in zip(at, ends)]
    return out


def exact_quantiles(df: DataFrame, columns: dict[str, str], probs: list[float], cfg: LensConfig = DEFAULT,
                    ends: dict[str, tuple[float, float]] | None = None) -> dict[str, list[float] | None]:
    """Quantiles of several numeric SQL expressions, by name; one short list per expression comes back, None without values.

    Wide tables go in blocks of columns. ``ends`` are the exact minimum and maximum where the caller knows them; they save passes.
    """
    ends = ends or {}
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    names = list(columns)
    for start in range(0, len(names), cfg.columns_per_pass):
        block = names[start:start + cfg.columns_per_pass]
        values = df.selectExpr(*[f"CAST({columns[n]} AS DOUBLE) AS v{i}" for i, n in enumerate(block)])
        known = {i: ends[n] for i, n in enumerate(block) if n in ends}
        out |= {block[i]: q for i, q in _of_columns(values, probs, known).items()}
    return out


def grouped_median(
    df: DataFrame, keys: list[str], value: str, name: str = "median", cfg: LensConfig = DEFAULT
) -> DataFrame:
    """Exact median of one column per group, null for groups without values; a group may hold any share of the rows."""
    groups = df.select(*[col(k) for k in keys]).distinct()
    values = df.select(*[col(k).alias(f"g{i}") for i, k in enumerate(keys)], col(value).cast("double").alias("v"))
    found = selected(values, [f"g{i}" for i in range(len(keys))], [0.5], cfg)
    on = [col(k).eqNullSafe(F.col(f"g{i}")) for i, k in enumerate(keys)]
    return groups.join(found, on, "left").select(*[col(k) for k in keys], F.col("q")[0].alias(name))
