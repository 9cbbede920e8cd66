"""Column profiles: semantic types, numeric summaries, samples and warnings, one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens import fixed_values as fv
from tablelens.config import DEFAULT, LensConfig
from tablelens.functions import text as tx
from tablelens.functions.stats import finite
from tablelens.operators.cleaning import row_groups
from tablelens.operators.column_stats import NUMERIC_KINDS, pinned_stats
from tablelens.operators.summaries import smallest_hashes
from tablelens.sources.tables import pin_small, without_nan


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def semantic_type(cfg: LensConfig = DEFAULT) -> Column:
    """Meaning of a column, from a column-statistics row that has n_distinct."""
    kind, seen = F.col("kind"), F.col("rows") - F.col("nulls")
    distinct = F.col("n_distinct")
    mostly_unique = _ratio(distinct, F.col("rows")) > cfg.identifier_ratio
    return (
        F.when(seen == 0, "categorical")
        .when((kind == "boolean") | ((kind == "string") & (F.col("not_boolean") == 0)), "boolean")
        .when((kind == "datetime") | (_ratio(F.col("best_date"), seen) >= cfg.date_text_rate), "datetime")
        .when((kind == "integer") & mostly_unique & (distinct > cfg.identifier_min_int), "identifier")
        .when(kind.isin(*NUMERIC_KINDS), "numeric")
        .when((kind == "string") & mostly_unique & (distinct > cfg.identifier_min_text), "identifier")
        .when((kind == "string") & (F.col("avg_length") > cfg.long_text), "text")
        .otherwise("categorical")
    )


def numeric_summary() -> Column:
    r = lambda c: F.round(c, 4)
    return F.struct(
        r("min_num").alias("min"), r("max_num").alias("max"), r("mean").alias("mean"), r("median").alias("median"),
        r("std").alias("std"), r("q1").alias("q1"), r("q3").alias("q3"), r("skewness").alias("skewness"),
        F.col("n_outside").alias("outlier_count_iqr"))


def column_profile(stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Statistics with n_distinct and n_outside -> one profile row per column."""
    typed = stats.withColumn("semantic_type", semantic_type(cfg))
    return typed.select(
        "ord", "column", "type", "semantic_type", F.col("rows").alias("row_count"),
        F.col("nulls").alias("missing_count"),
        F.round(100 * _ratio(F.col("nulls"), F.col("rows")), 2).alias("missing_pct"),
        F.col("n_distinct").alias("unique_count"),
        F.when(F.col("semantic_type") == "numeric", numeric_summary()).alias("numeric_summary"),
        warning_label(cfg).alias("warning"),
    )


def _is_high_cardinality(cfg: LensConfig) -> Column:
    return ((F.col("semantic_type") == "categorical") & (F.col("n_distinct") > cfg.high_cardinality_min)
            & (_ratio(F.col("n_distinct"), F.col("rows")) > cfg.high_cardinality_ratio))


def _is_near_constant(cfg: LensConfig) -> Column:
    return (F.col("n_distinct") <= cfg.near_constant) & (F.col("nulls") < F.col("rows"))


def _constant_label() -> Column:
    return F.when(F.col("n_distinct") <= 1, "constant").otherwise("near_constant")


def warning_label(cfg: LensConfig = DEFAULT) -> Column:
    """The one label shown beside a column: near-constant wins over high cardinality."""
    return F.when(_is_near_constant(cfg), _constant_label()).when(_is_high_cardinality(cfg), "high_cardinality")


def warnings(stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """ord, column, type, detail for every warning of a table, from statistics with n_distinct."""
    typed = stats.withColumn("semantic_type", semantic_type(cfg))
    share = F.round(_ratio(F.col("n_distinct"), F.col("rows")) * 100, 1)
    missing = 100 * _ratio(F.col("nulls"), F.col("rows"))
    text = lambda c: c.cast("string")
    found = F.array(
        F.when(_is_high_cardinality(cfg), F.struct(
            F.lit("high_cardinality").alias("type"),
            F.concat(text(F.col("n_distinct")), F.lit(" unique / "), text(F.col("rows")), F.lit(" rows ("),
                     text(share), F.lit("%)")).alias("detail"))),
        F.when(_is_near_constant(cfg), F.struct(
            _constant_label().alias("type"),
            F.concat(F.lit("Only "), text(F.col("n_distinct")), F.lit(" unique value(s)")).alias("detail"))),
        F.when(missing > cfg.high_missing_pct, F.struct(
            F.lit("high_missing").alias("type"),
            F.concat(text(F.round(missing, 1)), F.lit("% missing")).alias("detail"))),
    )
    return (typed.select("ord", "column", F.posexplode(F.filter(found, lambda w: w.isNotNull())).alias("step", "w"))
            .select("ord", "column", "step", "w.type", "w.detail"))


def columns_by_type(profile: DataFrame) -> DataFrame:
    """The six semantic types with their columns in table order; types without columns have an empty list."""
    types = profile.sparkSession.createDataFrame([(i, t) for i, t in enumerate(fv.SEMANTIC_TYPES)],
                                                 "type_ord int, semantic_type string")
    lists = profile.groupBy("semantic_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "column"))), lambda s: s["column"]).alias("columns"))
    return types.join(F.broadcast(lists), "semantic_type", "left").select(
        "type_ord", "semantic_type", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


# ---------------------------------------------------------------- value lists per column

def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text), n for the non-null values of several columns, in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), tx.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def sample_values(df: DataFrame, stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Up to five distinct values per column, those with the lowest hash: column, values. One scan, in which tasks keep no more than these."""
    names = [r["column"] for r in stats.select("column", "ord").orderBy("ord").collect()]
    types = {f.name: f.dataType for f in df.schema}
    shown = []
    for c in names:
        v = tx.sql(finite(tx.ident(c), types[c]))
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            v = F.round(v, 4)
        if not isinstance(types[c], T.AtomicType):
            v = F.when(v.isNotNull(), F.to_json(F.struct(v.alias("v"))))
        shown.append(v)
    found = smallest_hashes(df, shown, cfg.sample_size)
    named = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (i, c)])
    return pin_small(found.groupBy(named[F.col("ord")].alias("column")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("values")))


# ---------------------------------------------------------------- whole tables

def profile(df: DataFrame, cfg: LensConfig = DEFAULT, distinct: str = "exact") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile a table: (columns, table summary, warnings)."""
    df = without_nan(df)
    stats = pinned_stats(df, cfg, distinct=distinct, outlier_k=cfg.profile_iqr)
    columns = column_profile(stats, cfg).join(F.broadcast(sample_values(df, stats, cfg)), "column", "left")
    columns = columns.withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
    return pin_small(columns.orderBy("ord")), table_summary(df, cfg), warnings(stats, cfg)


def table_summary(df: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """One row: rows, columns, their names and the number of extra copies of rows."""
    return row_groups(df, cfg).select(
        F.col("rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        F.col("duplicate_rows").alias("duplicate_row_count"))


def table_shape(df: DataFrame) -> DataFrame:
    """One row: rows and columns, by a plain count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"))


def needs_quoting(c: Column) -> Column:
    return ~c.rlike(fv.PLAIN_IDENTIFIER)


def profile_documents(columns: DataFrame) -> DataFrame:
    """ord, document: one compact JSON text per column, for a reader that plans charts."""
    entry = F.struct(
        F.col("column").alias("name"), "semantic_type", "missing_pct", "unique_count",
        F.when(needs_quoting(F.col("column")), F.concat(F.lit('"'), "column", F.lit('"'))).alias("sql_reference"),
        F.when(F.col("numeric_summary").isNotNull(),
               F.col("numeric_summary").dropFields("q1", "q3")).alias("stats"),
        F.when(F.size("values") > 0, F.slice("values", 1, 5)).alias("sample_values"),
        "warning")
    return columns.select("ord", F.to_json(entry).alias("document"))


def profile_document(columns: DataFrame) -> DataFrame:
    """The column documents of a table as one JSON array, in column order."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "document"))), lambda s: s["document"])
    return profile_documents(columns).agg(F.concat(F.lit("["), F.concat_ws(",", docs), F.lit("]")).alias("document"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
