"""Profiles that are stored and merged: the statistics of a table's parts (days, files) give those of any union of parts without a rescan.

A row per part and column holds counts, extremes, central moments, a HyperLogLog sketch of the values and a KLL sketch of the numbers. All of
these merge exactly or within the sketches' own bounds: distinct counts to about DISTINCT_ERROR, ranks of quantiles to RANK_ERROR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import text as tx
from tablelens.functions.stats import finite
from tablelens.operators.column_stats import NUMERIC_KINDS, hash_parts, kind_of

LOG_SIZE, KLL_SIZE = 14, 400
#: Three standard errors of the distinct count, relative; error of a quantile's rank, as a share of the values, with 99 % confidence.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_SIZE / 2), 0.0077


def stored_profile(df: DataFrame, part: str | None = None) -> DataFrame:
    """part, ord, column, type, kind, rows, nulls, n, mean, m2, m3, min_num, max_num, distinct_sketch, rank_sketch; one scan.

    ``part`` is an SQL expression that names each row's part. NaN counts as missing. m2 and m3 are sums of powers of deviations from the mean.
    Columns that are no numbers have no moments and no rank sketch. A table without rows has no profile rows.
    """
    structs = []
    for i, f in enumerate(df.schema):
        c = finite(tx.ident(f.name), f.dataType)
        num = f"CAST({c} AS DOUBLE)" if kind_of(f.dataType) in NUMERIC_KINDS else "CAST(NULL AS DOUBLE)"
        structs.append(f"struct({i} AS ord, {num} AS num, CASE WHEN {c} IS NOT NULL THEN xxhash64({', '.join(hash_parts(c, f.dataType))}) END AS h)")
    rows = df.selectExpr(f"{part or 'CAST(NULL AS STRING)'} AS part", f"inline(array({', '.join(structs)}))")
    made = rows.groupBy("part", "ord").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("h").isNull()).alias("nulls"), F.count("num").alias("n"), F.avg("num").alias("mean"),
        F.coalesce(F.var_pop("num") * F.count("num"), F.lit(0.0)).alias("m2"),
        F.coalesce(F.skewness("num") * F.pow(F.var_pop("num"), F.lit(1.5)) * F.count("num"), F.lit(0.0)).alias("m3"),
        F.min("num").alias("min_num"), F.max("num").alias("max_num"), F.expr(f"hll_sketch_agg(h, {LOG_SIZE})").alias("distinct_sketch"),
        F.expr(f"kll_sketch_agg_double(num, {KLL_SIZE})").alias("rank_sketch"))
    named = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema)]
    schema = df.sparkSession.createDataFrame(named, "ord int, column string, type string, kind string")
    return made.join(F.broadcast(schema), "ord").select("part", "ord", "column", "type", "kind", *made.columns[2:])


def merged_profile(stored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One stored row per column (and per value of ``by``, columns of the caller's such as a month) out of those of all parts."""
    keys = [*(by or []), "ord", "column", "type", "kind"]
    total = stored.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    d = F.coalesce(F.col("mean") - F.col("_mean"), F.lit(0.0))
    both = stored.join(total, same).select(*keys, "_mean", d.alias("d"), "rows", "nulls", "n", "m2", "m3", "min_num", "max_num",
                                           "distinct_sketch", "rank_sketch")
    return both.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.expr("m2 + n * d * d")).alias("m2"), F.sum(F.expr("m3 + 3 * d * m2 + n * d * d * d")).alias("m3"),
        F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        F.expr("hll_union_agg(distinct_sketch, true)").alias("distinct_sketch"),
        F.expr(f"kll_merge_agg_double(rank_sketch, {KLL_SIZE})").alias("rank_sketch")).select(
        *(by or []), F.lit(None).cast("string").alias("part"), *keys[len(by or []):], "rows", "nulls", "n", "mean", "m2", "m3", "min_num", "max_num",
        "distinct_sketch", "rank_sketch")


def profile_figures(stored: DataFrame) -> DataFrame:
    """The figures of stored rows: counts, moments and extremes exact, n_distinct, q1, median and q3 by sketch."""
    n = F.col("n").cast("double")
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (n - 1)))
    skew = F.when((F.col("n") >= 3) & (F.col("m2") > 0),
                  F.col("m3") / n / F.pow(F.col("m2") / n, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2))
    quantile = lambda p: F.expr(f"CASE WHEN n > 0 THEN kll_sketch_get_quantile_double(rank_sketch, {p}D) END")
    numeric = F.col("kind").isin(*NUMERIC_KINDS)
    return stored.select(
        *[c for c in stored.columns if c not in ("distinct_sketch", "rank_sketch", "m2", "m3", "mean", "min_num", "max_num", "n")],
        F.least(F.expr("hll_sketch_estimate(distinct_sketch)"), F.col("rows") - F.col("nulls")).alias("n_distinct"),
        "min_num", "max_num", "mean", F.when(numeric, spread).alias("std"), F.when(numeric, skew).alias("skewness"),
        quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"))
