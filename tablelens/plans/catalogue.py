"""Which rule-based charts a table gets, in which order; chart data is computed only for the rows kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens import fixed_values as fv
from tablelens.config import DEFAULT, LensConfig
from tablelens.operators import chart_data as cd
from tablelens.operators.column_stats import NUMERIC_KINDS, pinned_stats
from tablelens.sources.tables import pin_small, without_nan

COLUMNS = ["priority", "a", "b", "rule", "title", "x", "y"]


# ---------------------------------------------------------------- roles

def identifier_test(cfg: LensConfig = DEFAULT) -> Column:
    """By name, or an integer whose values are almost all different."""
    by_name = F.lower(F.trim("column")).rlike("|".join(f"({p})" for p in fv.IDENTIFIER_NAME_PATTERNS))
    seen = F.greatest(F.col("rows") - F.col("nulls"), F.lit(1)).cast("double")
    return by_name | ((F.col("kind") == "integer") & (F.col("n_distinct") / seen > cfg.chart_identifier_ratio))


def datetime_test(cfg: LensConfig = DEFAULT) -> Column:
    """A datetime type, or text that mostly parses as a date in one or more of the known formats."""
    share = F.try_divide(F.col("any_date").cast("double"), (F.col("rows") - F.col("nulls")).cast("double"))
    return (F.col("kind") == "datetime") | (
        (F.col("kind") == "string") & (F.coalesce(share, F.lit(0.0)) >= cfg.date_text_rate))


def column_roles(stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Chart role per column, from statistics with n_distinct and exact quartiles.

    role is datetime, identifier, sparse, numeric, categorical or other; numerics carry their interest rank
    (largest spread first) and categoricals whether they are readable as bars.
    """
    missing = F.coalesce(F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    role = (F.when(datetime_test(cfg), "datetime").when(identifier_test(cfg), "identifier")
            .when(missing > cfg.missing_rate, "sparse")
            .when(F.col("kind").isin(*NUMERIC_KINDS), "numeric")
            .when(F.col("kind").isin("boolean", "string"), "categorical").otherwise("other"))
    rows = stats.select("*", role.alias("role"), missing.alias("missing_share"), cd.has_outliers(cfg).alias("has_outliers"))
    # one row per column of the table, so this window is schema-sized
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY role ORDER BY coalesce(std, 0) DESC, ord) AS place")
    return ranked.select(
        "ord", "column", "kind", "role", "missing_share", "n_distinct", "nulls", "std",
        F.when(F.col("role") == "numeric", F.col("place")).cast("bigint").alias("interest"), "has_outliers",
        ((F.col("role") == "categorical") & (F.col("n_distinct") <= cfg.low_cardinality)).alias("readable"))


def _listed(condition: Column, *fields) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.struct(*fields))))


def _role_lists(roles: DataFrame, cfg: LensConfig) -> DataFrame:
    """All roles of a table as arrays in one row; sections of the catalogue unfold them."""
    cat, num = F.col("role") == "categorical", F.col("role") == "numeric"
    return roles.agg(
        _listed((F.col("role") == "datetime") & (F.col("missing_share") <= cfg.missing_rate), "ord", "column").alias("times"),
        _listed(cat & F.col("readable"), "ord", "column", "n_distinct").alias("readable"),
        _listed(cat & ~F.col("readable"), "ord", "column", "n_distinct").alias("wide"),
        _listed(num, "interest", "column").alias("numerics"),
        _listed(num, (~F.col("has_outliers")).alias("calm"), "interest", "column").alias("shapes"),
        F.coalesce(F.bool_or(F.col("nulls") > 0), F.lit(False)).alias("any_missing"),
    )


# ---------------------------------------------------------------- sections

def _section(rows: DataFrame, priority: int, rule, title, x=None, y=None, a=None, b=None) -> DataFrame:
    none, zero = F.lit(None).cast("string"), F.lit(0)
    return rows.select(
        F.lit(priority).alias("priority"),
        F.coalesce(a if a is not None else zero, zero).cast("int").alias("a"),
        F.coalesce(b if b is not None else zero, zero).cast("int").alias("b"),
        (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), title.alias("title"),
        (x if x is not None else none).alias("x"), (y if y is not None else none).alias("y"))


def _one(lists: DataFrame, name: str) -> DataFrame:
    return lists.select(F.posexplode(name).alias("a", "one"))


def _two(lists: DataFrame, outer: str, inner: Column) -> DataFrame:
    return lists.select(F.posexplode(outer).alias("a", "one"), inner.alias("inner")).select(
        "a", "one", F.posexplode("inner").alias("b", "two"))


def _rest(name: str, after: int) -> Column:
    return F.slice(name, after + 1, F.greatest(F.size(name) - after, F.lit(0)))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _first_sections(lists: DataFrame, cfg: LensConfig) -> list[DataFrame]:
    one, two = F.col("one.column"), F.col("two.column")
    at = {"a": F.col("a")}
    both = {"a": F.col("a"), "b": F.col("b")}
    wide_enough = F.filter("readable", lambda c: c["n_distinct"] >= 2)
    shapes = _one(lists, "shapes")
    by_time = _two(lists, "times", F.slice("numerics", 1, cfg.numerics_per_datetime))
    by_cat = _two(lists.withColumn("readable", wide_enough), "readable", F.slice("numerics", 1, cfg.numerics_per_category))
    return [
        _section(lists, 1, "R00", F.lit("Dataset summary")),
        _section(lists.where("any_missing"), 1, "R12", F.lit("Data health — missing values"), a=F.lit(1)),
        _section(_one(lists, "times"), 2, "R07", _text("Records over time: ", one), one, **at),
        _section(_one(lists, "readable"), 3, "R03", _text("Count of '", one, "'"), one, **at),
        _section(by_time, 4, "R08", _text("Average '", two, "' over time"), one, two, **both),
        _section(shapes, 5, F.when(F.col("one.calm"), "R01").otherwise("R02"), _text("Distribution: ", one), one, **at),
        _section(by_cat, 6, "R04", _text("'", two, "' by '", one, "'"), one, two, **both),
    ]


def _pool_sections(lists: DataFrame, cfg: LensConfig) -> list[DataFrame]:
    one, two = F.col("one.column"), F.col("two.column")
    at = {"a": F.col("a")}
    both = {"a": F.col("a"), "b": F.col("b")}
    enough = lambda name: F.filter(name, lambda c: c["n_distinct"] >= 2)
    more = _two(lists.withColumn("readable", enough("readable")), "readable", _rest("numerics", cfg.numerics_per_category))
    wide = _two(lists.withColumn("wide", enough("wide")), "wide", F.col("numerics"))
    later = _two(lists, "times", _rest("numerics", cfg.numerics_per_datetime))
    return [
        _section(_one(lists, "wide"), 9, "R11", _text("Counts: ", one, f" (top {cfg.top_n})"), one, **at),
        _section(more, 10, "R04", _text("'", two, "' by '", one, "'"), one, two, **both),
        _section(wide, 11, "R04", _text("'", two, "' by '", one, f"' (top {cfg.top_n})"), one, two, **both),
        _section(later, 12, "R08", _text("Average '", two, "' over time"), one, two, **both),
    ]


def _pair_sections(df: DataFrame, roles: DataFrame, pool: bool, cfg: LensConfig) -> list[DataFrame]:
    rows = roles.where("role = 'numeric'").orderBy("ord").collect()
    numerics = [r["column"] for r in rows]
    if len(numerics) < 2:
        return []
    strong = pin_small(cd.strong_pairs(df, numerics, cfg).select("ord", "x", "y", F.abs("r").alias("strength")))
    ranked = strong.selectExpr("*", "row_number() OVER (ORDER BY strength DESC, ord) AS place")
    title = _text("Scatter: ", F.col("x"), " vs ", F.col("y"))
    out = [_section(ranked.where("place = 1"), 7, "R05", title, F.col("x"), F.col("y"))]
    if pool:
        out.append(_section(ranked.where("place > 1"), 13, "R05", title, F.col("x"), F.col("y"), a=F.col("ord")))
    if len(numerics) >= 3:
        cells = pin_small(cd.heatmap(df, numerics, cfg=cfg)).limit(1)
        out.append(_section(cells, 8, "R06", F.lit("Correlation heatmap")))
    return out


def chart_catalogue(df: DataFrame, stats: DataFrame | None = None, max_charts: int | None = DEFAULT.max_charts,
                    cfg: LensConfig = DEFAULT) -> DataFrame:
    """priority, ord, rule, title, x, y; the first max_charts rows, or all candidates with None.

    Pairs of numerics are scanned only if the cap leaves room for them.
    """
    if stats is None:
        df = without_nan(df)
        stats = pinned_stats(df, cfg)
    roles = pin_small(column_roles(stats, cfg))
    lists = pin_small(_role_lists(roles, cfg))
    rows = pin_small(_union(_first_sections(lists, cfg)))
    if max_charts is None or rows.count() < max_charts:
        more = _pair_sections(df, roles, max_charts is None, cfg)
        if max_charts is None:
            more += _pool_sections(lists, cfg)
        rows = pin_small(_union([rows, *more]))
    numbered = rows.selectExpr("*", "row_number() OVER (ORDER BY priority, a, b, title) AS ord")
    kept = numbered if max_charts is None else numbered.where(F.col("ord") <= max_charts)
    return kept.select("priority", F.col("ord").cast("bigint").alias("ord"), "rule", "title", "x", "y").orderBy("ord")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def chart_frame(df: DataFrame, row, stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """The data of one catalogue row."""
    rule, x, y = row["rule"], row["x"], row["y"]
    if rule == "R00":
        return cd.dtype_counts(df)
    if rule == "R12":
        return cd.missing_tiers(stats, cfg)
    if rule == "R07":
        return cd.records_over_time(df, x, cfg=cfg)
    if rule in ("R03", "R11"):
        return cd.top_values(df, [x], cfg)
    if rule == "R08":
        return cd.average_over_time(df, x, y, cfg=cfg)
    if rule in ("R01", "R02"):
        return cd.histogram(df, x, cfg, outliers=rule == "R02")
    if rule == "R04":
        marked = stats.where(F.col("column") == y).select(cd.has_outliers(cfg)).first()
        return cd.by_category(df, y, x, median=bool(marked and marked[0]), cfg=cfg)
    if rule == "R05":
        return cd.density(df, x, y, cfg)
    if rule == "R06":
        roles = column_roles(stats, cfg).where("role = 'numeric'").orderBy("ord").collect()
        return cd.heatmap(df, [r["column"] for r in roles], cfg=cfg)
    raise ValueError(f"no data for rule {rule}")
