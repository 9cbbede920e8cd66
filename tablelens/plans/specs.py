"""Declarative chart specs: parsing, bulk validation, deterministic planning, and execution."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens import fixed_values as fv
from tablelens.config import DEFAULT, LensConfig
from tablelens.functions import text as tx
from tablelens.operators import chart_data as cd
from tablelens.operators.column_stats import NUMERIC_KINDS, kind_of
from tablelens.operators.quantiles import grouped_median
from tablelens.plans.sql_guard import check_sql
from tablelens.sources.tables import CLEAN_VIEW, cut_lineage

SPEC_SCHEMA = (
    "title string, chart_type string, business_question string, sql_query string, x_column string, y_column string, "
    "color_column string, aggregation string, sort_order string, `limit` int, x_label string, y_label string, "
    "plain_language_explanation string"
)


# ---------------------------------------------------------------- validation, as Columns over many specs

def _length_rule(name: str, low: int, high: int, required: bool = True) -> Column:
    bad = ~F.length(name).between(low, high)
    bad = F.col(name).isNull() | bad if required else F.coalesce(bad, F.lit(False))
    return F.when(bad, f"{name}_length")


def _choice_rule(name: str, allowed: tuple[str, ...], default_ok: bool = False) -> Column:
    missing = F.lit(False) if default_ok else F.col(name).isNull()
    return F.when(missing | ~F.col(name).isin(*allowed), name)


def field_violations() -> Column:
    """Required fields, lengths, ranges and vocabularies."""
    return _present(
        _length_rule("title", 3, 80), _choice_rule("chart_type", fv.CHART_TYPES),
        _length_rule("business_question", 10, 200), _choice_rule("aggregation", fv.AGGREGATIONS),
        _choice_rule("sort_order", fv.SORT_ORDERS, default_ok=True),
        F.when(~F.col("limit").between(2, 50), "limit"),
        _length_rule("x_label", 0, 60, required=False), _length_rule("y_label", 0, 60, required=False),
        _length_rule("plain_language_explanation", 20, 300),
    )


def sql_violations() -> Column:
    """A read-only statement over the cleaned view; forbidden words count anywhere in the text."""
    text = F.upper(F.regexp_replace("sql_query", r"^\s+|\s+$", ""))
    forbidden = [F.when(text.rlike(rf"\b{w}\b"), f"sql_{w.lower()}") for w in fv.FORBIDDEN_SQL_WORDS]
    return _present(
        F.when(F.col("sql_query").isNull() | ~text.startswith("SELECT"), "sql_not_select"), *forbidden,
        F.when(F.col("sql_query").isNull() | ~F.upper("sql_query").contains(fv.REQUIRED_SQL_SOURCE), "sql_source"),
    )


def cross_field_violations() -> Column:
    kind, x, y = F.col("chart_type"), F.col("x_column"), F.col("y_column")
    agg, order = F.col("aggregation"), F.coalesce("sort_order", F.lit("none"))
    return _present(
        F.when((kind == "histogram") & y.isNotNull(), "histogram_has_y"),
        F.when((kind == "histogram") & x.isNull(), "histogram_without_x"),
        F.when((kind == "scatter") & (x.isNull() | y.isNull()), "scatter_without_axes"),
        F.when((kind == "heatmap") & (x.isNotNull() | y.isNotNull()), "heatmap_has_axes"),
        F.when(kind.isin("scatter", "histogram") & (agg != "NONE"), "raw_chart_aggregates"),
        F.when(kind.isin("bar", "line") & (agg == "NONE"), "bar_or_line_without_aggregate"),
        F.when((kind == "line") & order.isin("asc", "desc"), "line_is_sorted"),
    )


def _present(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda v: v.isNotNull())


def validate_specs(specs: DataFrame) -> DataFrame:
    """Specs with violations ARRAY<STRING>: field rules, then SQL rules, then rules across fields."""
    return specs.withColumn("violations", F.concat(field_violations(), sql_violations(), cross_field_violations()))


def batch_sizes(specs: DataFrame, key: str, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Specs per response and whether their number is allowed."""
    return specs.groupBy(key).agg(F.count(F.lit(1)).alias("n_specs")).withColumn(
        "size_ok", F.col("n_specs").between(cfg.min_specs, cfg.max_specs))


# ---------------------------------------------------------------- responses

def strip_fences(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^(```json)?(```)?\s*", ""), r"\s*(```)?\s*$", "")


def parse_responses(responses: DataFrame, key: str, text: str) -> DataFrame:
    """Response texts -> one row per spec: key, pos, spec fields. Malformed responses yield none."""
    body = F.col("_body")
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, f"charts array<struct<{_struct_fields()}>>"))
    # the outer form, because the plain one has a filter inferred that parses every response again
    return responses.select(tx.col(key), strip_fences(tx.col(text)).alias("_body")).select(
        tx.col(key), F.posexplode_outer(parsed["charts"]).alias("pos", "s")).where("pos IS NOT NULL").select(tx.col(key), "pos", "s.*")


def _struct_fields() -> str:
    return re.sub(r"(`?\w+`?) (\w+)", r"\1: \2", SPEC_SCHEMA)


def accept_responses(responses: DataFrame, key: str, text: str, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Specs of the responses that are valid as a whole: every spec passes and their number is allowed."""
    checked = cut_lineage(validate_specs(parse_responses(responses, key, text)))  # used twice, and dear to parse
    good = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("violations")).alias("worst"),
    ).where((F.col("worst") == 0) & F.col("n").between(cfg.min_specs, cfg.max_specs)).select(key)
    return checked.join(good, key, "left_semi").drop("violations")


def parse_insights(responses: DataFrame, key: str, text: str, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Insight lists, given as {"insights": [...]} or a bare array: key, pos, insight. Non-text items are left out."""
    json = F.try_parse_json(strip_fences(tx.col(text)))
    bare, wrapped = (F.try_variant_get(json, path, "array<variant>") for path in ("$", "$.insights"))
    rows = responses.select(tx.col(key), F.coalesce(bare, wrapped).alias("items"))
    strings = F.filter("items", lambda v: F.schema_of_variant(v) == "STRING")
    first = F.slice(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), 1, cfg.max_insights)
    return rows.select(tx.col(key), F.posexplode(first).alias("pos", "insight"))


# ---------------------------------------------------------------- planning

def plan_specs(profile: DataFrame, pairs: DataFrame | None = None, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Three to five specs for a profiled table, by fixed rules: a count per category, a distribution, a
    comparison, a trend if there is a date, and a scatter if two numerics move together (strongest of ``pairs``).

    Identifiers, long text and mostly missing columns are not used; skewed numerics are compared by median;
    more than ten categories are cut to the top ten; outliers are mentioned.
    """
    usable = profile.where((F.col("missing_pct") <= cfg.high_missing_pct)
                           & ~F.coalesce(F.col("warning") == "constant", F.lit(False)))

    def first_of(*types: str) -> Column:
        return F.min(F.when(F.col("semantic_type").isin(*types), F.struct(
            "ord", "column", "unique_count",
            F.coalesce(F.col("numeric_summary.skewness"), F.lit(0.0)).alias("skew"),
            F.coalesce(F.col("numeric_summary.outlier_count_iqr"), F.lit(0)).alias("outliers"))))

    one = usable.agg(first_of("categorical", "boolean").alias("c"), first_of("numeric").alias("v"),
                     first_of("datetime").alias("t"))
    if pairs is not None:
        best = pairs.where(F.abs("r") > cfg.pair_r).agg(F.max_by(F.struct("x", "y"), F.abs("r")).alias("p"))
        p = best.first()["p"]
        px, py = (F.lit(p["x"]), F.lit(p["y"])) if p else (F.lit(None).cast("string"),) * 2
    else:
        px = py = F.lit(None).cast("string")

    cat, num, when = F.col("c.column"), F.col("v.column"), F.col("t.column")
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    top = F.when(F.col("c.unique_count") > cfg.high_cardinality_min, f" LIMIT {cfg.top_n}").otherwise("")
    middle = F.when(F.abs("v.skew") > cfg.skew_for_median, "MEDIAN").otherwise("AVG")
    word = F.when(middle == "MEDIAN", "Median").otherwise("Average")
    note = F.when(F.col("v.outliers") > 0, say(" It has ", F.col("v.outliers").cast("string"), " unusual values.")).otherwise("")
    none = F.lit(None).cast("string")

    def spec(present, title, kind, question, sql, x, y, agg, order, x_label, y_label, text):
        fields = [title, F.lit(kind), question, sql, x, y, none, agg, F.lit(order), F.lit(cfg.top_n), x_label, y_label, text]
        names = [n.split(" ")[0].strip("`") for n in SPEC_SCHEMA.split(", ")]
        return F.when(present, F.struct(*[f.alias(n) for f, n in zip(fields, names)]))

    specs = F.array(
        spec(cat.isNotNull(), say("Number of rows by ", cat), "bar", say("How many rows does each ", cat, " have?"),
             say("SELECT ", q(cat), f" , COUNT(*) AS n FROM {CLEAN_VIEW} GROUP BY ", q(cat), " ORDER BY n DESC", top),
             cat, F.lit("n"), F.lit("COUNT"), "desc", cat, F.lit("Rows"), say("Shows how many rows each ", cat, " has.")),
        spec(num.isNotNull(), say("Distribution of ", num), "histogram", say("How are the values of ", num, " spread?"),
             say("SELECT ", q(num), f" FROM {CLEAN_VIEW} WHERE ", q(num), " IS NOT NULL"),
             num, none, F.lit("NONE"), "none", num, F.lit("Rows"), say("Shows how often each range of ", num, " occurs.", note)),
        spec(num.isNotNull() & cat.isNotNull(), say(word, " ", num, " by ", cat), "bar",
             say("Which ", cat, " has the highest ", num, "?"),
             say("SELECT ", q(cat), ", ", middle, "(", q(num), f") AS result FROM {CLEAN_VIEW} GROUP BY ", q(cat),
                 " ORDER BY result DESC", top),
             cat, F.lit("result"), middle, "desc", cat, say(word, " ", num), say("Compares ", num, " between the values of ", cat, ".", note)),
        spec(when.isNotNull(), say("Rows per month of ", when), "line", say("How does the number of rows change over ", when, "?"),
             say("SELECT date_trunc('month', ", q(when), f") AS month, COUNT(*) AS n FROM {CLEAN_VIEW} "
                 "GROUP BY date_trunc('month', ", q(when), ") ORDER BY month"),
             F.lit("month"), F.lit("n"), F.lit("COUNT"), "none", F.lit("Month"), F.lit("Rows"),
             say("Shows the number of rows in each month of ", when, ".")),
        spec(px.isNotNull(), say(px, " and ", py), "scatter", say("Do ", px, " and ", py, " move together?"),
             say("SELECT ", q(px), ", ", q(py), f" FROM {CLEAN_VIEW} WHERE ", q(px), " IS NOT NULL AND ", q(py), " IS NOT NULL"),
             px, py, F.lit("NONE"), "none", px, py, say("Each point is a row; ", px, " against ", py, ".")),
    )
    found = F.filter(specs, lambda s: s.isNotNull())
    return one.select(F.posexplode(F.slice(found, 1, cfg.max_specs)).alias("pos", "s")).select("pos", "s.*")


# ---------------------------------------------------------------- execution

def spark_sql_text(query: str) -> str:
    """Double-quoted identifiers as Spark writes them; text literals stay as they are."""
    def swap(m: re.Match) -> str:
        name = m.group("name")
        return m.group(0) if name is None else tx.ident(name.replace('""', '"'))

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?P<name>(?:[^\"]|\"\")*)\"", swap, query)


_MEDIAN_SHAPE = re.compile(
    r"""\s*SELECT\s+(?P<x>"(?:[^"]|"")+"|\w+)\s*,\s*MEDIAN\(\s*(?P<v>"(?:[^"]|"")+"|\w+)\s*\)\s+AS\s+(?P<y>"(?:[^"]|"")+"|\w+)\s+FROM\s+"""
    rf"""{CLEAN_VIEW}\s+GROUP\s+BY\s+(?P<g>"(?:[^"]|"")+"|\w+)(?:\s+ORDER\s+BY\s+(?P<o>"(?:[^"]|"")+"|\w+)\s*(?P<dir>ASC|DESC)?)?"""
    r"""(?:\s+LIMIT\s+(?P<n>\d+))?\s*;?\s*""", re.I)


def _name(text: str) -> str:
    return text[1:-1].replace('""', '"') if text.startswith('"') else text


def _median_frame(spark: SparkSession, query: str) -> DataFrame | None:
    """A median per group as the bounded operator computes it, if the statement is just that; else None."""
    m = _MEDIAN_SHAPE.fullmatch(query)
    if not m or _name(m["x"]) != _name(m["g"]) or m["o"] and _name(m["o"]) != _name(m["y"]):
        return None
    order = (m["dir"] or "asc").lower() if m["o"] else "none"
    return spec_frame(spark.table(CLEAN_VIEW), _name(m["x"]), _name(m["v"]), "MEDIAN", sort_order=order,
                      limit=int(m["n"]) if m["n"] else None, result=_name(m["y"]))


def _plain_dates(df: DataFrame) -> DataFrame:
    """date_trunc gives zoned timestamps; the cleaned view has none."""
    zoned = {f.name: tx.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"}
    return df.withColumns(zoned) if zoned else df


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """A spec's SELECT over the registered cleaned view. The parsed statement decides: anything else is refused unexecuted."""
    median = _median_frame(spark, query)
    if median is not None:
        return median
    text = spark_sql_text(query)
    check_sql(spark, text)
    return _plain_dates(spark.sql(text))


def bind_check(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Analyse each query without running it: title, ok, error. Needs only the schema of the cleaned view."""
    found = []
    for s in specs:
        try:
            run_sql(spark, s["sql_query"])
            found.append((s["title"], True, None))
        except (PySparkException, ValueError) as e:
            found.append((s["title"], False, str(e).splitlines()[0]))
    return spark.createDataFrame(found, "title string, ok boolean, error string")


def run_specs(spark: SparkSession, specs: list[dict]) -> tuple[list[tuple[dict, DataFrame]], list[str]]:
    """Query results of the specs that can run, and one error text for each that cannot."""
    results, errors = [], []
    for s in specs:
        try:
            results.append((s, render_data(run_sql(spark, s["sql_query"]), s)))
        except (PySparkException, ValueError) as e:
            errors.append(f"Chart '{s['title']}' failed: {e}")
    return results, errors


def spec_frame(df: DataFrame, x: str, y: str | None = None, aggregation: str = "COUNT", color: str | None = None,
               time_unit: str | None = None, sort_order: str = "none", limit: int | None = None,
               result: str = "y", cfg: LensConfig = DEFAULT) -> DataFrame:
    """A spec evaluated without SQL text: x [, color], result."""
    base = df
    if time_unit:
        base = df.withColumn(x, F.date_trunc(time_unit, cd.as_timestamp(df, x)).cast("timestamp_ntz"))
    keys = [x] + ([color] if color else [])
    if aggregation == "NONE":
        cols = keys + ([y] if y else [])
        out = base.select(*[tx.col(c) for c in cols]).dropna(subset=[tx.ident(c) for c in cols])
        return _ordered(out, y, sort_order, keys, limit)
    if aggregation == "MEDIAN":
        out = grouped_median(base.select(*[tx.col(c) for c in dict.fromkeys(keys + [y])]), keys, y, result, cfg)
    else:
        value = tx.col(y) if y else F.lit(1)
        how = {"COUNT": F.count, "AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}[aggregation]
        out = base.groupBy(*[tx.col(k) for k in keys]).agg(how(value).alias(result))
    return _ordered(out, result, sort_order, keys, limit)


def _ordered(out: DataFrame, y: str | None, sort_order: str, keys: list[str], limit: int | None) -> DataFrame:
    """Sorted by the result, ties by the keys; a limit without an order follows the keys."""
    first = []
    if y and sort_order != "none":
        first = [F.asc(tx.ident(y)) if sort_order == "asc" else F.desc(tx.ident(y))]
    if first or limit:
        out = out.orderBy(*first, *[tx.col(k) for k in keys])
    return out.limit(limit) if limit else out


def render_data(result: DataFrame, spec: dict, cfg: LensConfig = DEFAULT) -> DataFrame:
    """What a chart of this spec draws: bins for a histogram, correlations for a heatmap, else the sorted rows."""
    y, order = spec.get("y_column"), spec.get("sort_order") or "none"
    if order != "none" and y in result.columns:
        result = result.orderBy(F.asc(tx.ident(y)) if order == "asc" else F.desc(tx.ident(y)))
    if spec["chart_type"] == "histogram":
        return cd.histogram(result, spec["x_column"], cfg)
    if spec["chart_type"] == "heatmap":
        numeric = [f.name for f in result.schema if kind_of(f.dataType) in NUMERIC_KINDS]
        return cd.heatmap(result, numeric, listwise=False, mask=False, cfg=cfg)
    return result


def result_preview(result: DataFrame, order: list[str] | None = None, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Shape and the first rows of a result as JSON, in one row: preview."""
    ordered = result.orderBy(*[tx.col(c) for c in order]) if order else result
    top = ordered.limit(cfg.preview_rows).select(F.to_json(F.struct("*")).alias("row")).toArrow().column("row").to_pylist()
    rows = F.array(*[F.lit(r) for r in top]) if top else F.array().cast("array<string>")
    shape = F.concat(F.lit("Result shape: "), F.col("n").cast("string"), F.lit(f" rows × {len(result.columns)} columns"))
    return result.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") > 0, F.concat(shape, F.lit("\nFirst rows:\n["), F.concat_ws(",\n ", rows), F.lit("]")))
        .otherwise(F.lit(fv.EMPTY_RESULT_TEXT)).alias("preview"))


def merge_catalogues(spec_charts: DataFrame, rule_charts: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Spec charts; when fewer than three worked, all rule charts follow: source, ord, title."""
    few = spec_charts.count() < cfg.min_specs
    own = spec_charts.select(F.lit("llm").alias("source"), "ord", "title")
    return own.unionByName(rule_charts.select(F.lit("fallback").alias("source"), "ord", "title")) if few else own
