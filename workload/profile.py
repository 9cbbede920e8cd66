"""Profiles: statistics, semantic types, warnings and samples."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F

from tablelens.config import DEFAULT
from tablelens.operators import profiling as pf
from tablelens.operators.column_stats import column_stats, distinct_counts, pinned_stats, with_distinct, with_exact_quartiles, with_outliers
from tablelens.operators.stored_profile import DISTINCT_ERROR, RANK_ERROR, merged_profile, profile_figures, stored_profile
from tablelens.sources.tables import pin_small
from workload.common import (
    DOCS_SQL, labelled_documents, query, rounded, skewness_sql, table, union, union_sql,
)

_LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINEITEM_TEXT = ["l_returnflag", "l_linestatus"]


def _number_summary_sql(t: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""
SELECT '{c}' AS "column", count(*) AS rows, round(100 * (1 - count({c}) / count(*)), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct,
  round(min({x}), 4) AS min_num, round(max({x}), 4) AS max_num, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
  round(quantile_cont({x}, 0.25), 4) AS q1, round(quantile_cont({x}, 0.5), 4) AS median, round(quantile_cont({x}, 0.75), 4) AS q3,
  CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text FROM {t}"""


def _text_summary_sql(t: str, c: str) -> str:
    return f"""
SELECT '{c}', count(*), round(100 * (1 - count({c}) / count(*)), 2), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR) FROM {t}"""


def _summary(stats):
    out = stats.withColumn("null_pct", F.round(100 * F.col("nulls") / F.col("rows"), 2)).select(
        "column", "rows", "null_pct", "n_distinct", "min_num", "max_num", "mean", "std", "q1", "median", "q3", "min_text", "max_text")
    return rounded(out, "min_num", "max_num", "mean", "std", "q1", "median", "q3")


@query("table_shape", union_sql([
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({n} AS INTEGER) AS column_count FROM {t}"
    for t, n in (("lineitem", 11), ("orders", 6), ("events", 6), ("embeddings", 3))]))
def table_shape(spark, sf_dir):
    return union([pf.table_shape(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "row_count", "column_count")
                  for t in ("lineitem", "orders", "events", "embeddings")])


@query("column_summary", union_sql(
    [_number_summary_sql("lineitem", c) for c in _LINEITEM_NUM]
    + [_text_summary_sql("lineitem", c) for c in _LINEITEM_TEXT + ["l_shipdate"]]))
def column_summary(spark, sf_dir):
    """Every column of lineitem: counts, nulls, distinct values, extremes, moments and exact quartiles."""
    return _summary(pinned_stats(table(spark, sf_dir, "lineitem"), distinct="exact", text_rules=False))


@query("column_summary_approx")
def column_summary_approx(spark, sf_dir):
    """The same in one scan, with sketched distinct counts and quartiles."""
    df = table(spark, sf_dir, "lineitem")
    return _summary(with_distinct(df, column_stats(df, text_rules=False), "approx"))


@query("skewness_sample", union_sql([
    f"SELECT '{c}' AS \"column\", {skewness_sql(c)} AS skewness FROM {t}"
    for t, c in [("lineitem", c) for c in _LINEITEM_NUM] + [("events", "value"), ("documents", "n_chars")]]))
def skewness_sample(spark, sf_dir):
    parts = [(("lineitem"), _LINEITEM_NUM), ("events", ["value"]), ("documents", ["n_chars"])]
    return rounded(union([column_stats(table(spark, sf_dir, t).select(*c)).select("column", "skewness") for t, c in parts]),
                   "skewness")


def _outlier_sql(t: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", count(*) AS n_outside FROM {t}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t}) WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"""


@query("iqr_outlier_count", union_sql([_outlier_sql("events", "value"), _outlier_sql("documents", "n_chars"),
                                       _outlier_sql("lineitem", "l_extendedprice"), _outlier_sql("lineitem", "l_tax")]))
def iqr_outlier_count(spark, sf_dir):
    parts = []
    for t, cols in (("events", ["value"]), ("documents", ["n_chars"]), ("lineitem", ["l_extendedprice", "l_tax"])):
        df = table(spark, sf_dir, t).select(*cols)
        stats = with_exact_quartiles(df, pin_small(column_stats(df, text_rules=False)))
        parts.append(with_outliers(df, stats, DEFAULT.profile_iqr).select("column", "n_outside"))
    return union(parts)


# ---------------------------------------------------------------- semantic types

# fixed facts of the tables: column -> storage kind
_KINDS = {
    "region": {"r_regionkey": "i", "r_name": "s"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t",
               "o_orderpriority": "s"},
    "lineitem": {**{c: "i" for c in _LINEITEM_NUM[:4]}, **{c: "d" for c in _LINEITEM_NUM[4:]},
                 **{c: "s" for c in _LINEITEM_TEXT}, "l_shipdate": "t"},
    "events": {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"},
    "documents": {"doc_id": "i", "text": "s", "lang": "s", "source": "s", "n_chars": "i"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "pages": {"page_id": "i", "url": "s", "html": "s"},
    "embeddings": {"vec_id": "i", "embedding": "o", "label": "i"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "s", "text": "s"},
    "benchmark": {"item_id": "i", "text": "s"},
}
_BOOLEAN_WORDS = "('true','false','yes','no','1','0','t','f','y','n')"


def _type_sql(t: str, c: str, k: str) -> str:
    u, n = f"count(DISTINCT {c})", "count(*)"
    case = {
        "i": f"CASE WHEN {u} / {n} > 0.9 AND {u} > 100 THEN 'identifier' ELSE 'numeric' END",
        "d": "'numeric'", "t": "'datetime'", "o": "'categorical'",
        "s": f"CASE WHEN count(*) FILTER (lower(trim({c})) NOT IN {_BOOLEAN_WORDS}) = 0 THEN 'boolean' "
             f"WHEN {u} / {n} > 0.9 AND {u} > 50 THEN 'identifier' WHEN avg(length({c})) > 50 THEN 'text' ELSE 'categorical' END",
    }[k]
    return f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'categorical' ELSE {case} END AS semantic_type FROM {t}"


_YES_NO_SQL = """SELECT 'yes_no' AS table_name, 'yes_no' AS "column",
  CASE WHEN count(*) FILTER (yes_no NOT IN ('yes', 'no')) = 0 THEN 'boolean' ELSE 'categorical' END AS semantic_type
  FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 'yes' ELSE 'no' END AS yes_no FROM lineitem)"""


@query("semantic_types", union_sql([_type_sql(t, c, k) for t, cols in _KINDS.items() for c, k in cols.items()] + [_YES_NO_SQL]))
def semantic_types(spark, sf_dir):
    """The meaning of every column of every table."""
    frames = {t: table(spark, sf_dir, t) for t in _KINDS}
    frames["yes_no"] = frames["lineitem"].select(F.when(F.col("l_linestatus") == "F", "yes").otherwise("no").alias("yes_no"))
    with ThreadPool(4) as pool:  # small tables do not fill the cores, so a few are profiled at a time
        stats = pool.map(lambda df: pinned_stats(df, exact_quartiles=None), frames.values())
    return union([s.select(F.lit(t).alias("table_name"), "column", pf.semantic_type().alias("semantic_type"))
                  for t, s in zip(frames, stats)])


@query("semantic_type_summary", f"""
WITH k AS (SELECT * FROM ({union_sql([_type_sql("customer", c, k) for c, k in _KINDS["customer"].items()])}))
SELECT t.semantic_type, coalesce(string_agg("column", ',' ORDER BY "column"), '') AS columns
FROM (VALUES ('numeric'), ('categorical'), ('datetime'), ('boolean'), ('text'), ('identifier')) t(semantic_type)
LEFT JOIN k USING (semantic_type) GROUP BY t.semantic_type""")
def semantic_type_summary(spark, sf_dir):
    stats = pinned_stats(table(spark, sf_dir, "customer"), exact_quartiles=None)
    typed = stats.select("ord", "column", pf.semantic_type().alias("semantic_type"))
    return pf.columns_by_type(typed).select("semantic_type", F.array_join(F.array_sort("columns"), ",").alias("columns"))


# ---------------------------------------------------------------- profile columns

@query("sample_values")
def sample_values(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    stats = pinned_stats(df, distinct="approx", exact_quartiles=False, text_rules=False)
    return pf.sample_values(df, stats)


_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "lang_some"]


@query("missing_profile", union_sql([f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, round(100 * (1 - count({c}) / count(*)), 2) AS missing_pct
FROM {DOCS_SQL}""" for c in _DOC_COLUMNS]))
def missing_profile(spark, sf_dir):
    stats = pinned_stats(labelled_documents(spark, sf_dir), outlier_k=DEFAULT.profile_iqr)
    return pf.column_profile(stats).select("column", "missing_count", "missing_pct")


def _numeric_sql(t: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""
SELECT '{c}' AS "column", round(min({x}), 4) AS "min", round(max({x}), 4) AS "max", round(avg({x}), 4) AS mean,
  round(quantile_cont({x}, 0.5), 4) AS median, round(stddev_samp({x}), 4) AS std, round(quantile_cont({x}, 0.25), 4) AS q1,
  round(quantile_cont({x}, 0.75), 4) AS q3, {skewness_sql(c)} AS skewness,
  (SELECT n_outside FROM ({_outlier_sql(t, c)})) AS outlier_count_iqr FROM {t}"""


@query("numeric_summary", union_sql([_numeric_sql("orders", "o_custkey"), _numeric_sql("orders", "o_totalprice"),
                                     _numeric_sql("events", "user_id"), _numeric_sql("events", "value")]))
def numeric_summary(spark, sf_dir):
    parts = [pf.column_profile(pinned_stats(table(spark, sf_dir, t), outlier_k=DEFAULT.profile_iqr)) for t in ("orders", "events")]
    return union([p.where("semantic_type = 'numeric'").select("column", "numeric_summary.*") for p in parts])


# ---------------------------------------------------------------- warnings

def _warnings(spark, sf_dir, names, kind):
    frames = [(t, labelled_documents(spark, sf_dir) if t == "labelled" else table(spark, sf_dir, t)) for t in names]
    return union([pf.warnings(pinned_stats(df, distinct="exact", exact_quartiles=False)).where(F.col("type").isin(*kind))
                  .select(F.lit(t).alias("table_name"), "column", "type", "detail") for t, df in frames])


@query("warn_high_cardinality", union_sql([f"""
SELECT '{t}' AS table_name, '{c}' AS "column", 'high_cardinality' AS type,
  concat(u, ' unique / ', n, ' rows (', round(100 * u / n, 1), '%)') AS detail
FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n, ({_type_sql(t, c, k).replace(f"'{t}' AS table_name, '{c}' AS " + '"column", ', "")}) AS st FROM {t})
WHERE st = 'categorical' AND u / n > 0.5 AND u > 10"""
    for t in ("nation", "benchmark", "supplier") for c, k in _KINDS[t].items() if k == "s"]))
def warn_high_cardinality(spark, sf_dir):
    return _warnings(spark, sf_dir, ["nation", "benchmark", "supplier"], ["high_cardinality"])


@query("warn_near_constant", union_sql([f"""
SELECT '{t}' AS table_name, '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' ELSE 'near_constant' END AS type,
  concat('Only ', count(DISTINCT {c}), ' unique value(s)') AS detail FROM {t} HAVING count(DISTINCT {c}) <= 2 AND count({c}) > 0"""
    for t in ("labels", "lineitem") for c in _KINDS[t]]))
def warn_near_constant(spark, sf_dir):
    return _warnings(spark, sf_dir, ["labels", "lineitem"], ["constant", "near_constant"])


@query("warn_high_missing", union_sql([f"""
SELECT 'labelled' AS table_name, '{c}' AS "column", 'high_missing' AS type,
  concat(round(100 * (1 - count({c}) / count(*)), 1), '% missing') AS detail FROM {DOCS_SQL} HAVING 100 * (1 - count({c}) / count(*)) > 50"""
    for c in _DOC_COLUMNS]))
def warn_high_missing(spark, sf_dir):
    return _warnings(spark, sf_dir, ["labelled"], ["high_missing"])


@query("profile_json")
def profile_json(spark, sf_dir):
    """The compact JSON document of each column of events."""
    columns, _, _ = pf.profile(table(spark, sf_dir, "events"))
    return pf.profile_documents(columns)


def _if_numeric(c: str, kind: str, type_: str) -> str:
    return f"CASE WHEN s.semantic_type = 'numeric' THEN n.{c} END" if kind in "id" else f"CAST(NULL AS {type_})"


@query("profile_json_fields", union_sql([f"""
SELECT s."column" AS name, s.semantic_type, m.missing_pct, m.unique_count, CAST(NULL AS VARCHAR) AS sql_reference, least(5, m.unique_count) AS samples,
  {_if_numeric('min', k, 'DOUBLE')} AS stat_min, {_if_numeric('median', k, 'DOUBLE')} AS stat_median,
  {_if_numeric('outlier_count_iqr', k, 'BIGINT')} AS stat_outliers
FROM ({_type_sql("events", c, k)}) s, (SELECT round(100 * (1 - count({c}) / count(*)), 2) AS missing_pct, count(DISTINCT {c}) AS unique_count FROM events) m
{f', ({_numeric_sql("events", c)}) n' if k in 'id' else ''}""" for c, k in _KINDS["events"].items()]))
def profile_json_fields(spark, sf_dir):
    """The JSON documents of events parsed back to columns."""
    columns, _, _ = pf.profile(table(spark, sf_dir, "events"))
    schema = ("name string, semantic_type string, missing_pct double, unique_count bigint, sql_reference string, sample_values array<string>, "
              "stats struct<min: double, median: double, outlier_count_iqr: bigint>")
    parsed = pf.profile_documents(columns).select(F.from_json("document", schema).alias("d"))
    return parsed.select("d.name", "d.semantic_type", "d.missing_pct", "d.unique_count", "d.sql_reference",
                         F.coalesce(F.size("d.sample_values"), F.lit(0)).cast("bigint").alias("samples"), F.col("d.stats.min").alias("stat_min"),
                         F.col("d.stats.median").alias("stat_median"), F.col("d.stats.outlier_count_iqr").alias("stat_outliers"))


@query("profile_json_quoting", """
SELECT '"' || type || ' n"' AS sql_reference, type || ' n' AS name, n FROM (SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type)""")
def profile_json_quoting(spark, sf_dir):
    """Columns whose names are no plain identifiers are quoted for SQL; here one per type of event, with the number of its rows."""
    events = table(spark, sf_dir, "events")
    wide = events.groupBy().pivot("event_type").agg(F.count(F.lit(1)))
    named = wide.toDF(*[f"{c} n" for c in wide.columns])
    documents = pf.profile_documents(pf.profile(named)[0]).select(F.from_json("document", "name string, sql_reference string").alias("d"))
    long = named.selectExpr(f"inline(array({', '.join(f'struct({chr(39)}{c}{chr(39)} AS name, `{c}` AS n)' for c in named.columns)}))")
    return documents.select("d.*").join(long, "name").select("sql_reference", "name", "n")


_STORED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


@query("stored_profile_merge", union_sql([f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, {f'CAST(min({c}) AS DOUBLE)' if n else 'CAST(NULL AS DOUBLE)'} AS min_num,
  {f'CAST(max({c}) AS DOUBLE)' if n else 'CAST(NULL AS DOUBLE)'} AS max_num, {f'round(avg({c}), 6)' if n else 'CAST(NULL AS DOUBLE)'} AS mean,
  {f'round(stddev_samp({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS std,
  {f'round(skewness({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS skewness, true AS distinct_near, true AS median_near FROM lineitem"""
    for c, n in zip(_STORED, (True, True, True, False))]))
def stored_profile_merge(spark, sf_dir):
    """Profiles of the parts of lineitem, a month of shipping each, merged without a scan; sketches held against exact figures."""
    df = table(spark, sf_dir, "lineitem")
    parts = pin_small(stored_profile(df.select("l_shipdate", *_STORED), "date_format(l_shipdate, 'yyyy-MM')"))
    figures = profile_figures(merged_profile(parts)).where(F.col("column") != "l_shipdate")
    exact = distinct_counts(df, _STORED)
    medians = {r["column"]: r["median"] for r in figures.collect()}
    ranks = df.agg(*[F.try_divide(F.count_if(F.col(c) <= medians[c]), F.count(c)).alias(f"{c}_upto") for c in _STORED[:3]],
                   *[F.try_divide(F.count_if(F.col(c) < medians[c]), F.count(c)).alias(f"{c}_below") for c in _STORED[:3]]).first()
    near = [(c, abs(r - exact[c]) <= DISTINCT_ERROR * exact[c] + 1, c not in _STORED[:3] or
             ranks[f"{c}_below"] - RANK_ERROR <= 0.5 <= ranks[f"{c}_upto"] + RANK_ERROR)
            for c, r in [(r["column"], r["n_distinct"]) for r in figures.collect()]]
    known = spark.createDataFrame(near, "column string, distinct_near boolean, median_near boolean")
    return rounded(rounded(figures.join(known, "column"), "mean", digits=6), "std", "skewness").select(
        "column", "rows", "nulls", "min_num", "max_num", "mean", "std", "skewness", "distinct_near", "median_near")


# ---------------------------------------------------------------- properties of results that SQL cannot repeat

@query("column_summary_approx_bounds", union_sql([f"SELECT '{c}' AS \"column\", true AS distinct_near, true AS median_near FROM lineitem HAVING count(*) > 0"
                                                  for c in _LINEITEM_NUM]))
def column_summary_approx_bounds(spark, sf_dir):
    """Sketches against exact figures: distinct counts within four standard errors, the median's rank within its accuracy."""
    df = table(spark, sf_dir, "lineitem").select(*_LINEITEM_NUM)
    near = with_distinct(df, column_stats(df, text_rules=False), "approx").select("column", F.col("n_distinct").alias("a"), F.col("median").alias("m"))
    exact = pinned_stats(df, distinct="exact", text_rules=False).select("column", "n_distinct", "median", "std")
    return near.join(exact, "column").select(
        "column", (F.abs(F.col("a") - F.col("n_distinct")) <= 4 * DEFAULT.distinct_rsd * F.col("n_distinct") + 1).alias("distinct_near"),
        (F.abs(F.col("m") - F.col("median")) <= 0.05 * F.col("std") + 1e-9).alias("median_near"))


_SAMPLED = ["doc_id", "text", "lang", "source", "n_chars"]


@query("sample_values_members", union_sql([
    f"SELECT '{c}' AS \"column\", least(5, count(DISTINCT {c})) AS n, least(5, count(DISTINCT {c})) AS members FROM documents" for c in _SAMPLED]))
def sample_values_members(spark, sf_dir):
    """Each sample has the size it should, and its values are values of the column."""
    df = table(spark, sf_dir, "documents").select(*_SAMPLED)
    stats = pinned_stats(df, distinct="approx", exact_quartiles=False, text_rules=False)
    shown = pf.sample_values(df, stats).select("column", F.explode("values").alias("value"))
    known = pf.value_counts(df, _SAMPLED).select("column", "value", F.lit(1).alias("known"))
    return shown.join(known, ["column", "value"], "left").groupBy("column").agg(
        F.count_distinct("value").alias("n"), F.count("known").alias("members"))
