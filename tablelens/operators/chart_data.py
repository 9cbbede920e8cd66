"""The data behind each rule-based chart. Every function but scatter_points returns a chart-sized DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.config import DEFAULT, LensConfig
from tablelens.functions import text as tx
from tablelens.functions.stats import correlation_p_value, finite, from_sums, t_statistic
from tablelens.operators.column_stats import kind_of
from tablelens.operators.quantiles import exact_quantiles, grouped_median
from tablelens.operators.summaries import most_frequent
from tablelens.sources.tables import pin_small


# ---------------------------------------------------------------- overview

def dtype_counts(df: DataFrame) -> DataFrame:
    """Rows and columns of the table and, per data type, how many columns have it."""
    types: dict[str, int] = {}
    for f in df.schema:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    per_type = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(n).cast("bigint").alias("n_columns"))
                         for t, n in types.items()])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), F.inline(per_type))


def first_columns(df: DataFrame, n: int = 20) -> DataFrame:
    """The columns that the overview names: ord, column, type of the first n, and how many more there are."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    more = max(0, len(rows) - n)
    return df.sparkSession.createDataFrame([(*r, more) for r in rows[:n]], "ord int, column string, type string, more int")


def missing_tiers(stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Columns with missing values, worst first, with a colour tier."""
    pct = 100 * F.col("nulls").cast("double") / F.col("rows")
    return stats.where("nulls > 0").select(
        "ord", "column", pct.alias("missing_pct"),
        F.when(pct > cfg.missing_red_pct, "red").when(pct > cfg.missing_amber_pct, "amber").otherwise("grey").alias("tier"),
    ).orderBy(F.desc("missing_pct"), "ord")


# ---------------------------------------------------------------- one numeric

def histogram(df: DataFrame, column: str, cfg: LensConfig = DEFAULT, outliers: bool = False) -> DataFrame:
    """Equal-width bins over the non-null values, empty bins included: bin, bin_lo, bin_hi, n.

    With ``outliers`` also the fences and whether the bin lies outside them.
    """
    x = tx.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi, bins = ends.lo, ends.hi, cfg.bins
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, n bigint")
    if lo == hi:
        bins, place = 1, F.lit(0).cast("bigint")
    else:
        place = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    counts = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    out = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    if not outliers:
        return out
    lower, upper = outlier_bounds(df, [column], cfg)[column]
    return out.select("*", F.lit(lower).alias("lower"), F.lit(upper).alias("upper"),
                      ((F.col("bin_hi") < F.lit(lower)) | (F.col("bin_lo") > F.lit(upper))).alias("outside"))


def outlier_bounds(df: DataFrame, columns: list[str], cfg: LensConfig = DEFAULT) -> dict[str, tuple[float, float]]:
    quartiles = exact_quantiles(df, {c: tx.ident(c) for c in columns}, [0.25, 0.75], cfg)
    return {c: (q[0] - cfg.chart_iqr * (q[1] - q[0]), q[1] + cfg.chart_iqr * (q[1] - q[0]))
            for c, q in quartiles.items() if q}


def has_outliers(cfg: LensConfig = DEFAULT) -> Column:
    """From a statistics row with exact quartiles: the extremes alone tell whether any value lies outside."""
    reach = cfg.chart_iqr * (F.col("q3") - F.col("q1"))
    return F.coalesce((F.col("rows") - F.col("nulls") >= cfg.outlier_min_rows)
                      & ((F.col("min_num") < F.col("q1") - reach) | (F.col("max_num") > F.col("q3") + reach)), F.lit(False))


# ---------------------------------------------------------------- categories

def top_values(df: DataFrame, columns: list[str], cfg: LensConfig = DEFAULT) -> DataFrame:
    """The most frequent values of several columns: column, rank, value, n; never shuffles all values of a column."""
    found = most_frequent(df, [tx.col(c) for c in columns], cfg)
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (i, c)])
    return found.select(names[F.col("ord")].alias("column"), "rank", "value", "n")


def by_category(df: DataFrame, value: str, category: str, median: bool = False, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Mean or median of a numeric per category, over rows that have both; the highest first, top_n rows."""
    both = df.where(tx.col(value).isNotNull() & tx.col(category).isNotNull()).select(
        tx.col(category).alias("category"), tx.col(value).alias("value"))
    if median:
        grouped = grouped_median(both, ["category"], "value", "result", cfg)
    else:
        grouped = both.groupBy("category").agg(F.avg("value").alias("result"))
    shown = grouped.select(F.col("category").cast("string").alias("category"), "result")
    return shown.orderBy(F.desc("result"), "category").limit(cfg.top_n)


# ---------------------------------------------------------------- time

def as_timestamp(df: DataFrame, column: str) -> Column:
    """A datetime column, or date text in any of the known formats; what does not parse is null."""
    kind = kind_of(df.schema[column].dataType)
    if kind == "string":
        return tx.sql(tx.parse_any_date(tx.ident(column)))
    return tx.col(column).cast("timestamp_ntz")


def period_for(span_days: int | None, cfg: LensConfig = DEFAULT) -> str:
    if span_days is not None and span_days > cfg.month_span_days:
        return "month"
    return "week" if span_days is not None and span_days > cfg.week_span_days else "day"


def auto_period(cfg: LensConfig = DEFAULT) -> Column:
    """The same choice as a Column over span_days."""
    return (F.when(F.col("span_days") > cfg.month_span_days, "month")
            .when(F.col("span_days") > cfg.week_span_days, "week").otherwise("day"))


def span_days(df: DataFrame, ts: Column) -> int | None:
    return df.agg(F.timestamp_diff("DAY", F.min(ts), F.max(ts))).first()[0]


def _period(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")


def records_over_time(df: DataFrame, column: str, unit: str | None = None, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Rows per period; periods without rows do not appear."""
    rows = df.select(as_timestamp(df, column).alias("ts")).where("ts IS NOT NULL")
    unit = unit or period_for(span_days(rows, F.col("ts")), cfg)
    return rows.groupBy(_period(unit, F.col("ts"))).agg(F.count(F.lit(1)).alias("n")).orderBy("period")


def average_over_time(df: DataFrame, column: str, value: str, unit: str | None = None, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Mean of a numeric per period, over rows that have both."""
    rows = df.select(as_timestamp(df, column).alias("ts"), tx.col(value).alias("value")).dropna()
    unit = unit or period_for(span_days(rows, F.col("ts")), cfg)
    return rows.groupBy(_period(unit, F.col("ts"))).agg(F.avg("value").alias("mean")).orderBy("period")


# ---------------------------------------------------------------- pairs of numerics

PAIR_SCHEMA = "ord int, x string, y string, n bigint, r double"


def correlations(df: DataFrame, pairs: list[tuple[str, str]], cfg: LensConfig = DEFAULT) -> DataFrame:
    """r of column pairs over the rows where both are present: ord, x, y, n, r; null without spread.

    Two scans for all pairs: column means first, then masked Gram matrices of the deviations. A task adds up the matrices of its Arrow blocks,
    and its sums meet those of other tasks by column pair. Very many columns take more scans, each for as many pairs of column blocks
    as fit gram_bytes.
    """
    place = {c: i for i, c in enumerate(dict.fromkeys(c for p in pairs for c in p))}
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    values = df.selectExpr(*[f"CAST({finite(tx.ident(c), df.schema[c].dataType)} AS DOUBLE) AS v{i}" for c, i in place.items()])
    centre = values.agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in place.values()]).first()
    means = np.array([centre[f"v{i}"] or 0.0 for i in place.values()])
    sums = None
    for tiles in _tiles(len(place), {(min(place[x], place[y]), max(place[x], place[y])) for x, y in pairs}, cfg):
        part = gram_sums(values, means, tiles)
        sums = part if sums is None else sums.unionByName(part)
    wanted = [(k, x, y, *sorted((place[x], place[y])), float(means[place[x]]), float(means[place[y]]), place[x] > place[y])
              for k, (x, y) in enumerate(pairs)]
    named = df.sparkSession.createDataFrame(wanted, "ord int, x string, y string, i int, j int, mx double, my double, turned boolean")
    found = named.join(sums, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    ends = [F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("sx", "sy"), ("sy", "sx"), ("sxx", "syy"), ("syy", "sxx"))]
    return found.select("ord", "x", "y", "n", "mx", "my", *ends, "sxy").select("ord", "x", "y", "n", from_sums().alias("r"))


def _tiles(columns: int, wanted: set[tuple[int, int]], cfg: LensConfig) -> list[list[tuple[range, range]]]:
    """Pairs of column blocks that hold wanted pairs, in lists whose matrices fit a task together."""
    size = cfg.gram_columns
    blocks = [range(low, min(low + size, columns)) for low in range(0, columns, size)]
    tiles = [(blocks[a], blocks[b]) for a, b in sorted({(i // size, j // size) for i, j in wanted})]
    many = max(1, cfg.gram_bytes // (6 * 8 * size * size))
    return [tiles[low:low + many] for low in range(0, len(tiles), many)]


def gram_sums(values: DataFrame, means: np.ndarray, tiles: list[tuple[range, range]]) -> DataFrame:
    """i, j, n, sx, sy, sxx, syy, sxy of the deviations of columns i <= j over the rows that have both, for the given column blocks."""
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((6, len(a), len(b))) for a, b in tiles]
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float) - means
            there = ~np.isnan(x)
            x[~there] = 0.0
            mask = there.astype(float)
            square = x * x
            for total, (a, b) in zip(totals, tiles):
                a, b = slice(a.start, a.stop), slice(b.start, b.stop)
                total += np.stack([mask[:, a].T @ mask[:, b], x[:, a].T @ mask[:, b], mask[:, a].T @ x[:, b],
                                   square[:, a].T @ mask[:, b], mask[:, a].T @ square[:, b], x[:, a].T @ x[:, b]])
        for total, (a, b) in zip(totals, tiles):
            i, j = (m.reshape(-1) for m in np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij"))
            flat = total.reshape(6, -1)
            seen = (i <= j) & (flat[0] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[seen], pa.int32()), pa.array(j[seen], pa.int32()), pa.array(np.rint(flat[0][seen]).astype(np.int64)),
                 *[pa.array(f[seen]) for f in flat[1:]]], ["i", "j", *names])

    rows = values.mapInArrow(add, "i int, j int, n bigint, " + ", ".join(f"{c} double" for c in names[1:]))
    return rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])


def strong_pairs(df: DataFrame, columns: list[str], cfg: LensConfig = DEFAULT) -> DataFrame:
    """Pairs with enough rows and |r| at or above the threshold, the strongest first."""
    pairs = correlations(df, list(combinations(columns, 2)), cfg)
    return pairs.where((F.col("n") >= cfg.pair_min_rows) & (F.abs("r") >= cfg.pair_r)).orderBy(F.desc(F.abs("r")), "ord")


def with_significance(pairs: DataFrame) -> DataFrame:
    """Add the t statistic and the two-sided p-value to a small table of pairs."""
    r, n = F.col("r"), F.col("n")
    return pairs.select("*", t_statistic(r, n).alias("t"), correlation_p_value(r, n).alias("p"))


def heatmap(df: DataFrame, columns: list[str], listwise: bool = True, mask: bool = True, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Correlation matrix in long form: x, y, r, shown.

    List-wise keeps only rows complete in all columns and needs three columns and five rows; pair-wise uses
    each pair's own rows. ``mask`` hides |r| below the threshold; a matrix with nothing to show comes back empty.
    """
    rows = df.dropna(subset=[tx.ident(c) for c in columns]) if listwise else df
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    half = correlations(rows, pairs, cfg)
    full = half.unionByName(half.where("x <> y").select(
        "ord", F.col("y").alias("x"), F.col("x").alias("y"), "n", "r"))
    shown = F.when((F.abs("r") >= cfg.heatmap_r) | F.lit(not mask), F.col("r"))
    cells = full.select("x", "y", "r", shown.alias("shown"), "n")
    if not listwise:
        return cells.drop("n")
    if len(columns) < 3:
        return cells.limit(0).drop("n")
    enough = F.max("n").over(_all()) >= cfg.heatmap_min_rows
    any_shown = F.count("shown").over(_all()) > 0
    return cells.withColumn("keep", enough & any_shown).where("keep").drop("keep", "n")


def _all():
    """One window over a table of column pairs (schema-sized)."""
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))


def density(df: DataFrame, x: str, y: str, cfg: LensConfig = DEFAULT) -> DataFrame:
    """A scatter of any size as chart-sized rows: kind (cell or point), x, y, x_hi, y_hi, n.

    Rows with both values are counted in a grid of equal cells from the lowest to the highest values. Cells with few rows come as these points
    themselves, so that outliers keep their places; equal points are one row with their number. A cell row has its lower and upper edges.
    """
    rows = scatter_points(df, x, y)
    ends = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    schema = "kind string, x double, y double, x_hi double, y_hi double, n bigint"
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], schema)
    size, low, width = cfg.density_cells, (ends[0], ends[2]), (ends[1] - ends[0], ends[3] - ends[2])

    def cell(c: str, k: int) -> Column:
        place = F.floor((F.col(c) - F.lit(low[k])) / F.lit(width[k]) * size) if width[k] else F.lit(0)
        return F.least(place, F.lit(size - 1)).cast("int").alias(f"c{c}")

    placed = rows.select("x", "y", cell("x", 0), cell("y", 1))
    counts = pin_small(placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")))  # at most density_cells squared rows
    edge = lambda c, k: F.lit(low[k]) + F.col(f"c{c}") * F.lit(width[k] / size)
    cells = counts.where(F.col("n") > cfg.density_points).select(
        F.lit("cell").alias("kind"), edge("x", 0).alias("x"), edge("y", 1).alias("y"), (edge("x", 0) + F.lit(width[0] / size)).alias("x_hi"),
        (edge("y", 1) + F.lit(width[1] / size)).alias("y_hi"), "n")
    few = counts.where(F.col("n") <= cfg.density_points).select("cx", "cy")
    points = placed.join(F.broadcast(few), ["cx", "cy"], "left_semi").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return cells.unionByName(points.select(F.lit("point").alias("kind"), "x", "y", F.col("x").alias("x_hi"), F.col("y").alias("y_hi"), "n"))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """All rows that have both values, as an export; a chart takes density."""
    return df.select(tx.col(x).cast("double").alias("x"), tx.col(y).cast("double").alias("y")).dropna()


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over the complete rows: slope, intercept, n, and the range of x."""
    return scatter_points(df, x, y).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Evenly spaced points of the trend line from the lowest to the highest x."""
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    at = F.col("x_min") + F.col("point") * step
    return trend(df, x, y).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).select(
        F.col("point").cast("bigint").alias("point"), at.alias("x"),
        (F.col("slope") * at + F.col("intercept")).alias("y"))
