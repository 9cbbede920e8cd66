"""Sources, screening, cleaning and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablelens.config import DEFAULT
from tablelens.operators import cleaning as cl
from tablelens.operators.column_stats import column_stats
from tablelens.plans import report as rp
from tablelens.sources import tables as src
from workload.common import (
    CURRENCY_SQL, DOCS_SQL, LINEITEM_DIRTY, LINEITEM_SQL, ORDERS_SQL, SENTINELS_SQL, dirty_lineitem, dirty_orders,
    labelled_documents, number_sql, query, rounded, table, union, union_sql,
)


# ---------------------------------------------------------------- sources

@query("csv_scan", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def csv_scan(spark, sf_dir):
    path = f"{src.shared_folder(spark)}/{spark.sparkContext.applicationId}/customer.csv"
    table(spark, sf_dir, "customer").write.mode("overwrite").option("header", True).csv(path)
    read = src.read_table(spark, path)
    return read.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
                       F.col("c_acctbal").cast("double"), "c_mktsegment")


def _schema_sql(name: str, columns: dict[str, str]) -> str:
    return union_sql([
        f"SELECT CAST({i} AS INTEGER) AS ord, '{c}' AS \"column\", '{t}' AS type, "
        f"count({c}) AS present FROM {name}" for i, (c, t) in enumerate(columns.items())])


_EVENTS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
           "value": "double", "props": "string"}


@query("schema_listing", _schema_sql("events", _EVENTS))
def schema_listing(spark, sf_dir):
    """Columns and types, with the values present in each."""
    df = table(spark, sf_dir, "events")
    counts = cl.null_counts(df).select("ord", (F.col("rows") - F.col("nulls")).alias("present"))
    return src.schema_rows(df).join(counts, "ord")


_EMBEDDINGS_KINDS = {"vec_id": "integer", "embedding": "other", "label": "integer"}


@query("type_dispatch", union_sql([
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, 'pass' AS action, count(*) AS rows FROM embeddings"
    for c, k in _EMBEDDINGS_KINDS.items()]))
def type_dispatch(spark, sf_dir):
    """Native types, nested ones among them, pass through cleaning."""
    decided = cl.decide(column_stats(table(spark, sf_dir, "embeddings")))
    return decided.select("column", "kind", "action", "rows")


_CLEAN_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                  "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _cleaned_sql(c: str) -> str:
    if c in ("price_txt", "price_few_na"):
        stripped = f"regexp_replace({c}, '[€$£¥₹,\\s]', '', 'g')"
        return f"CASE WHEN lower(trim({c})) NOT IN {SENTINELS_SQL} THEN {number_sql(stripped)} END"
    if c == "price_sparse":
        return f"CASE WHEN lower(trim({c})) NOT IN {SENTINELS_SQL} THEN {c} END"
    if c == "delta_txt":
        return number_sql(f"replace({c}, ',', '')")
    if c == "date_us":
        return f"TRY_STRPTIME({c}, '%m/%d/%Y')"
    return f"trim({c})"


_DERIVED = ["price_txt", "price_sparse", "price_few_na", "delta_txt", "mixed_txt", "flag_pad", "date_us"]


@query("cleaned_view", f"""
SELECT {', '.join(_CLEAN_COLUMNS)}, {', '.join(f'{_cleaned_sql(c)} AS {c}' for c in _DERIVED)}
FROM {LINEITEM_SQL}""")
def cleaned_view(spark, sf_dir):
    """The whole cleaned table: every row, with dropped columns gone and text columns converted."""
    cl.clean(dirty_lineitem(spark, sf_dir), check_rows=False).register()
    return spark.table(src.CLEAN_VIEW)


# ---------------------------------------------------------------- screening

@query("row_count", union_sql([f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"
                               for t in ("lineitem", "orders", "documents", "events")]))
def row_count(spark, sf_dir):
    return union([table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows")
                  for t in ("lineitem", "orders", "documents", "events")])


_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "lang_some"]


@query("null_counts", union_sql([
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM {DOCS_SQL}" for c in _DOC_COLUMNS]))
def null_counts(spark, sf_dir):
    return cl.null_counts(labelled_documents(spark, sf_dir)).select("column", "rows", "nulls")


def _decisions(df):
    return cl.screen(df)


_ALL_DIRTY = _CLEAN_COLUMNS + list(LINEITEM_DIRTY)


@query("dup_columns_removed", union_sql([
    f"SELECT '{c}' AS \"column\", {'true' if c == 'l_quantity.1' else 'false'} AS duplicate, "
    f"count(\"{c}\") AS present FROM {LINEITEM_SQL}" for c in _ALL_DIRTY]))
def dup_columns_removed(spark, sf_dir):
    return _decisions(dirty_lineitem(spark, sf_dir)).select(
        "column", (F.col("action") == "duplicate").alias("duplicate"), (F.col("rows") - F.col("nulls")).alias("present"))


@query("all_null_dropped", union_sql([
    f"SELECT '{c}' AS \"column\", count(\"{c}\") = 0 AS all_null FROM {LINEITEM_SQL}" for c in _ALL_DIRTY]))
def all_null_dropped(spark, sf_dir):
    return _decisions(dirty_lineitem(spark, sf_dir)).select("column", (F.col("action") == "all_null").alias("all_null"))


@query("constant_dropped", union_sql([
    f"SELECT '{c}' AS \"column\", count(DISTINCT \"{c}\") = 1 AS constant FROM {LINEITEM_SQL}" for c in _ALL_DIRTY]))
def constant_dropped(spark, sf_dir):
    return _decisions(dirty_lineitem(spark, sf_dir)).select("column", (F.col("action") == "constant").alias("constant"))


@query("kept_columns", union_sql([
    f"SELECT '{c}' AS \"column\", count(DISTINCT \"{c}\") > 1 AND '{c}' <> 'l_quantity.1' AS kept FROM {LINEITEM_SQL}"
    for c in _ALL_DIRTY]))
def kept_columns(spark, sf_dir):
    return _decisions(dirty_lineitem(spark, sf_dir)).select("column", "kept")


@query("nested_rows", """
WITH n AS (SELECT CASE WHEN user_id % 3 = 0 THEN [event_type, NULL] WHEN user_id % 3 = 1 THEN [event_type] ELSE [NULL, event_type] END AS tags,
  CASE WHEN user_id % 2 = 0 THEN {'a': event_type, 'b': NULL} ELSE {'a': NULL, 'b': event_type} END AS s FROM events),
g AS (SELECT count(*) AS c FROM n GROUP BY tags, s)
SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  count(*) FILTER (c > 1) AS duplicate_groups FROM g""")
def nested_rows(spark, sf_dir):
    """Rows of arrays and structs that differ only in where their nulls stand."""
    return cl.row_groups(table(spark, sf_dir, "events").selectExpr(
        "CASE user_id % 3 WHEN 0 THEN array(event_type, NULL) WHEN 1 THEN array(event_type) ELSE array(NULL, event_type) END AS tags",
        "CASE WHEN user_id % 2 = 0 THEN named_struct('a', event_type, 'b', CAST(NULL AS STRING)) "
        "ELSE named_struct('a', CAST(NULL AS STRING), 'b', event_type) END AS s"))


@query("csv_dialects", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, concat(c_name, '; "', c_mktsegment, '", |', chr(10), 'x') AS note, c_acctbal FROM customer""")
def csv_dialects(spark, sf_dir):
    """Semicolons between fields; quotes, commas and line breaks within them; the delimiter is found in the header."""
    path = f"{src.shared_folder(spark)}/csv-dialects-{uuid.uuid4().hex}"
    (table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('", |\nx')).alias("note"), "c_acctbal")
     .write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(path))
    return src.read_csv(spark, path)


@query("text_sample")
def text_sample(spark, sf_dir):
    """A repeatable sample of text values (a sampling operator, so it has a size)."""
    return cl.sample_text(table(spark, sf_dir, "documents"), "source", 200)


@query("text_sample_members", "SELECT least(200, count(source)) AS n, least(200, count(source)) AS members FROM documents")
def text_sample_members(spark, sf_dir):
    """The sample has its size, and its values are values of the column."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("source").alias("value"), F.lit(1).alias("known")).distinct()
    return cl.sample_text(docs, "source", 200).join(known, "value", "left").agg(F.count("value").alias("n"), F.count("known").alias("members"))


# ---------------------------------------------------------------- cleaning rules

def _cleaned(df, *columns):
    return cl.clean(df.select(*[f"`{c}`" for c in columns]), check_rows=False).table


@query("sentinel_nulls", f"""
SELECT l_orderkey, CASE WHEN lower(trim(price_sparse)) NOT IN {SENTINELS_SQL} THEN price_sparse END AS price_sparse,
       CASE WHEN lower(trim(price_few_na)) NOT IN {SENTINELS_SQL} THEN 1 ELSE 0 END AS few_present
FROM {LINEITEM_SQL}""")
def sentinel_nulls(spark, sf_dir):
    """Sentinel words become null; with 14% of them the currency cast is not applied and text stays."""
    out = _cleaned(dirty_lineitem(spark, sf_dir), "l_orderkey", "price_sparse", "price_few_na")
    return out.select("l_orderkey", "price_sparse",
                      F.when(F.col("price_few_na").isNotNull(), 1).otherwise(0).alias("few_present"))


@query("currency_to_double", f"""
SELECT l_orderkey, l_linenumber, {_cleaned_sql('price_txt')} AS price_txt, {_cleaned_sql('price_few_na')} AS price_few_na
FROM {LINEITEM_SQL}""")
def currency_to_double(spark, sf_dir):
    return _cleaned(dirty_lineitem(spark, sf_dir), "l_orderkey", "l_linenumber", "price_txt", "price_few_na")


@query("currency_rates", union_sql([f"""
SELECT '{c}' AS "column", count(*) FILTER (regexp_matches({c}, {CURRENCY_SQL})) AS currency_like,
       count({number_sql(f"regexp_replace({c}, '[€$£¥₹,{chr(92)}s]', '', 'g')")}) AS currency_cast,
       count(*) FILTER (lower(trim({c})) IN {SENTINELS_SQL}) AS sentinels
FROM {LINEITEM_SQL}""" for c in ("price_txt", "price_sparse", "price_few_na", "delta_txt", "mixed_txt")]))
def currency_rates(spark, sf_dir):
    """The whole-column counts behind the currency rule."""
    df = dirty_lineitem(spark, sf_dir).select("price_txt", "price_sparse", "price_few_na", "delta_txt", "mixed_txt")
    return column_stats(df).select("column", "currency_like", "currency_cast", "sentinels")


@query("numeric_string_cast", f"""
SELECT l_orderkey, l_linenumber, {_cleaned_sql('delta_txt')} AS delta_txt FROM {LINEITEM_SQL}""")
def numeric_string_cast(spark, sf_dir):
    return _cleaned(dirty_lineitem(spark, sf_dir), "l_orderkey", "l_linenumber", "delta_txt")


@query("mixed_types", f"""
SELECT 'mixed_txt' AS "column", count({number_sql("replace(mixed_txt, ',', '')")}) AS number_like,
       round(count({number_sql("replace(mixed_txt, ',', '')")}) / count(mixed_txt), 4) AS share,
       count({number_sql("replace(mixed_txt, ',', '')")}) / count(mixed_txt) BETWEEN 0.5 AND 0.95 AS mixed
FROM {LINEITEM_SQL}""")
def mixed_types(spark, sf_dir):
    out = _decisions(dirty_lineitem(spark, sf_dir).select("mixed_txt"))
    return rounded(out.select("column", "number_like", F.col("number_share").alias("share"),
                              (F.col("action") == "mixed").alias("mixed")), "share")


@query("trim_strings", f"""
SELECT l_orderkey, l_linenumber, trim(flag_pad) AS flag_pad FROM {LINEITEM_SQL}""")
def trim_strings(spark, sf_dir):
    return _cleaned(dirty_lineitem(spark, sf_dir), "l_orderkey", "l_linenumber", "flag_pad")


@query("datetime_cast", f"""
SELECT o_orderkey, CAST(TRY_STRPTIME(date_iso, '%Y-%m-%d') AS TIMESTAMP) AS date_iso,
       CAST(TRY_STRPTIME(date_us, '%m/%d/%Y') AS TIMESTAMP) AS date_us FROM {ORDERS_SQL}""")
def datetime_cast(spark, sf_dir):
    return _cleaned(dirty_orders(spark, sf_dir), "o_orderkey", "date_iso", "date_us")


@query("inconsistent_dates", f"""
SELECT 'date_mixed' AS "column", count(TRY_STRPTIME(date_mixed, '%Y-%m-%d')) AS dates,
       round(count(TRY_STRPTIME(date_mixed, '%Y-%m-%d')) / count(date_mixed), 4) AS share,
       count(TRY_STRPTIME(date_mixed, '%Y-%m-%d')) / count(date_mixed) BETWEEN 0.5 AND 0.95 AS inconsistent
FROM {ORDERS_SQL}""")
def inconsistent_dates(spark, sf_dir):
    out = _decisions(dirty_orders(spark, sf_dir).select("date_mixed"))
    return rounded(out.select("column", F.col("any_date").alias("dates"), F.col("any_date_share").alias("share"),
                              (F.col("action") == "mixed_dates").alias("inconsistent")), "share")


@query("high_missing", union_sql([f"""
SELECT '{c}' AS "column", round(1 - count({c}) / count(*), 4) AS null_share, 1 - count({c}) / count(*) > 0.4 AS high_missing
FROM {DOCS_SQL}""" for c in ("lang", "source", "lang_some")]))
def high_missing(spark, sf_dir):
    decided = _decisions(labelled_documents(spark, sf_dir).select("lang", "source", "lang_some"))
    return rounded(decided.select("column", "null_share", (F.col("null_share") > DEFAULT.high_null_rate).alias("high_missing")),
                   "null_share")


# ---------------------------------------------------------------- rows and tables

def _fence_sql(name: str, c: str, k: float) -> str:
    return f"""
SELECT '{c}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - {k} * (q3 - q1), 4) AS lower,
       round(q3 + {k} * (q3 - q1), 4) AS upper, round(CAST(mn AS DOUBLE), 4) AS min_num, round(CAST(mx AS DOUBLE), 4) AS max_num,
       (SELECT count(*) FROM {name} WHERE {c} < q1 - {k} * (q3 - q1) OR {c} > q3 + {k} * (q3 - q1)) AS n_outside
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
             min({c}) AS mn, max({c}) AS mx FROM {name})"""


@query("extreme_outliers", union_sql([_fence_sql("events", "value", 3.0), _fence_sql("documents", "n_chars", 3.0)]))
def extreme_outliers(spark, sf_dir):
    parts = [cl.extreme_outliers(table(spark, sf_dir, t), {c: c}) for t, c in (("events", "value"), ("documents", "n_chars"))]
    return rounded(union(parts), "q1", "q3", "lower", "upper", "min_num", "max_num")


_GROUP_SETS = {"lineitem": ["l_returnflag", "l_linestatus", "l_linenumber"], "documents": ["text"]}


def _groups_sql(t: str, columns: list[str], what: str) -> str:
    keys = ", ".join(columns)
    return f"SELECT '{t}' AS table_name, {what} FROM (SELECT {keys}, count(*) AS n FROM {t} GROUP BY {keys})"


@query("duplicate_row_groups", union_sql([
    _groups_sql(t, c, "count(*) FILTER (n > 1) AS duplicate_groups") for t, c in _GROUP_SETS.items()]))
def duplicate_row_groups(spark, sf_dir):
    return union([cl.row_groups(table(spark, sf_dir, t).select(*c)).select(F.lit(t).alias("table_name"), "duplicate_groups")
                  for t, c in _GROUP_SETS.items()])


@query("duplicate_row_count", union_sql([
    _groups_sql(t, c, "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows") for t, c in _GROUP_SETS.items()]))
def duplicate_row_count(spark, sf_dir):
    return union([cl.row_groups(table(spark, sf_dir, t).select(*c)).select(F.lit(t).alias("table_name"), "duplicate_rows")
                  for t, c in _GROUP_SETS.items()])


# ---------------------------------------------------------------- report

_REPORT = f"""
WITH d AS (SELECT *, {number_sql("replace(mixed_txt, ',', '')")} AS mixed_num FROM {LINEITEM_SQL}),
one AS (
  SELECT count(*) AS rows_, count(*) FILTER (lower(trim(price_sparse)) IN {SENTINELS_SQL}) AS s_sparse,
         count(*) FILTER (lower(trim(price_few_na)) IN {SENTINELS_SQL}) AS s_few,
         count(price_txt) AS n_price, count(price_few_na) AS n_few, count(delta_txt) AS n_delta,
         count(mixed_num) AS n_mixed, count(date_us) AS n_date,
         min(price_txt) AS ex_price, min(CASE WHEN price_few_na <> 'N/A' THEN price_few_na END) AS ex_few FROM d),
f AS (
  SELECT 0 AS ord, 'info' AS severity, CAST(NULL AS VARCHAR) AS "column", 'duplicate column removed' AS issue,
         '''l_quantity.1'' is a duplicate of ''l_quantity''. Excluded from view.' AS detail, CAST(NULL AS BIGINT) AS n FROM one
  UNION ALL SELECT 1, 'drop', 'empty_col', 'all-null column removed', '100% of values are NULL. No insight possible.', rows_ FROM one
  UNION ALL SELECT 2, 'drop', 'const_col', 'constant column removed', 'Single unique value across all rows. No insight possible.', 1 FROM one
  UNION ALL SELECT 3, 'drop', 'const_some', 'constant column removed', 'Single unique value across all rows. No insight possible.', 1 FROM one
  UNION ALL SELECT 4, 'info', 'price_txt', 'currency symbols stripped, cast to DOUBLE in view',
         concat('Example original value: ''', ex_price, ''''), n_price FROM one
  UNION ALL SELECT 5, 'info', 'price_sparse', 'sentinel null strings → NULL in view',
         concat(s_sparse, ' values like ''N/A'', ''unknown'', ''-'' replaced.'), s_sparse FROM one
  UNION ALL SELECT 6, 'info', 'price_few_na', 'sentinel null strings → NULL in view',
         concat(s_few, ' values like ''N/A'', ''unknown'', ''-'' replaced.'), s_few FROM one
  UNION ALL SELECT 7, 'info', 'price_few_na', 'currency symbols stripped, cast to DOUBLE in view',
         concat('Example original value: ''', ex_few, ''''), n_few - s_few FROM one
  UNION ALL SELECT 8, 'info', 'delta_txt', 'numeric strings cast to DOUBLE in view',
         '100% of sampled values are valid numbers.', n_delta FROM one
  UNION ALL SELECT 9, 'warn', 'mixed_txt', 'mixed types detected (numeric + text)',
         concat(CAST(round(100.0 * n_mixed / rows_) AS INTEGER), '% of values look numeric, ',
                CAST(round(100.0 - 100.0 * n_mixed / rows_) AS INTEGER),
                '% are text. Column kept as text. Avoid using as a numeric axis.'), n_mixed FROM one
  UNION ALL SELECT 10, 'info', 'date_us', 'datetime strings cast to TIMESTAMP in view',
         'Column consistently contains dates and was converted.', n_date FROM one)
"""


def _report(spark, sf_dir):
    return cl.clean(dirty_lineitem(spark, sf_dir)).report


@query("quality_report", _REPORT + 'SELECT CAST(ord AS INTEGER) AS ord, severity, "column", issue, detail, n FROM f')
def quality_report(spark, sf_dir):
    return _report(spark, sf_dir).select("ord", "severity", "column", "issue", "detail", "n")


@query("report_has_issues", _REPORT + "SELECT bool_or(severity IN ('warn', 'drop')) AS has_issues FROM f")
def report_has_issues(spark, sf_dir):
    return cl.has_issues(_report(spark, sf_dir))


@query("quality_context", _REPORT + """
SELECT concat('Data quality context (use when deciding which charts to generate):', chr(10),
  string_agg(concat('- ', CASE severity WHEN 'drop' THEN 'DROPPED' ELSE 'WARNING' END, ' ', "column", ': ', issue, '. ', detail),
             chr(10) ORDER BY ord)) AS context
FROM f WHERE severity IN ('drop', 'warn')""")
def quality_context(spark, sf_dir):
    return cl.context_text(_report(spark, sf_dir))


_SENTENCE = """, s AS (
  SELECT ord, severity, concat(coalesce('Column "' || "column" || '": ', ''), CASE
    WHEN issue LIKE 'all-null%' THEN 'No data found. Removed from analysis.'
    WHEN issue LIKE 'constant%' THEN 'Every row had the same value. Removed from analysis.'
    WHEN issue LIKE 'currency%' THEN 'Currency symbols removed. Values converted to numbers.'
    WHEN issue LIKE 'sentinel%' THEN concat(n, ' values like "N/A" or "unknown" treated as empty.')
    WHEN issue LIKE 'numeric%' THEN 'Numbers were stored as text. Converted to numeric.'
    WHEN issue LIKE 'datetime%' THEN 'Date text converted to proper date format.'
    WHEN issue LIKE 'duplicate column%' THEN 'Duplicate column removed.'
    WHEN issue LIKE 'mixed%' THEN 'Contains both numbers and text. Used as text only.' END) AS sentence FROM f)
"""


@query("report_sentences", _REPORT + _SENTENCE + "SELECT CAST(ord AS INTEGER) AS ord, severity, sentence FROM s")
def report_sentences(spark, sf_dir):
    return rp.sentences(_report(spark, sf_dir))


@query("report_bundle", _REPORT + _SENTENCE + """
SELECT true AS has_changes, count(*) AS n_sentences,
       concat('While preparing your data, the following changes were made:', chr(10), chr(10),
              string_agg(concat('  - ', sentence), chr(10) ORDER BY ord)) AS plain_text FROM s""")
def report_bundle(spark, sf_dir):
    return rp.bundle(_report(spark, sf_dir)).select(
        "has_changes", F.size("sentences").cast("bigint").alias("n_sentences"), "plain_text")


@query("report_buckets", _REPORT + _SENTENCE + """
SELECT CAST(CASE severity WHEN 'drop' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS INTEGER) AS bucket, CAST(ord AS INTEGER) AS ord,
       concat(CASE severity WHEN 'drop' THEN 'Removed' WHEN 'warn' THEN 'Note' ELSE 'Fixed' END, '  —  ', sentence) AS text FROM s""")
def report_buckets(spark, sf_dir):
    return rp.buckets(_report(spark, sf_dir))


@query("document_report", f"""
WITH d AS {DOCS_SQL},
w AS (SELECT count(*) FILTER (n > 1) AS g FROM (SELECT text, lang, source, n_chars, quality, toxic, lang_some, count(*) AS n
      FROM d GROUP BY ALL)),
o AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM d),
x AS (SELECT count(*) AS n FROM d, o WHERE n_chars < q1 - 3 * (q3 - q1) OR n_chars > q3 + 3 * (q3 - q1)),
z AS (SELECT 1 - count(lang_some) / count(*) AS share FROM d)
SELECT sentence FROM (
  SELECT concat('Column "n_chars": ', n, ' value(s) are unusually high or low. Shown as-is in charts.') AS sentence, n > 0 AS ok FROM x
  UNION ALL SELECT concat('Column "lang_some": ', CAST(round(100 * share) AS INTEGER), '% of values are empty. Charts may be incomplete.'),
         share > 0.4 FROM z
  UNION ALL SELECT concat(g, ' duplicate rows found in the data. Kept as-is.'), g > 0 FROM w) WHERE ok""")
def document_report(spark, sf_dir):
    """Warnings of a table with copies, outliers and missing values."""
    df = labelled_documents(spark, sf_dir).drop("doc_id")
    return rp.sentences(cl.clean(df).report).select("sentence")
