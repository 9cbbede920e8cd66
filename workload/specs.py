"""Spec-driven charts: structured specs, SQL specs, bulk validation and response parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.config import DEFAULT

from tablelens.operators import chart_data as cd
from tablelens.operators import profiling as pf
from tablelens.operators.column_stats import pinned_stats
from tablelens.plans import catalogue as ct
from tablelens.plans import specs as sp
from tablelens.plans.dashboard import build_dashboard
from tablelens.sources.tables import CLEAN_VIEW, register
from workload.charts import _EVENTS_CHARTS, _histogram_sql, _matrix_sql, _PRICED
from workload.common import PRICED_SQL, priced_lineitem, query, rounded, table, union
from workload.profile import _outlier_sql


# ---------------------------------------------------------------- structured specs

@query("spec_count", "SELECT o_orderpriority, count(*) AS y FROM orders GROUP BY 1")
def spec_count(spark, sf_dir):
    return sp.spec_frame(table(spark, sf_dir, "orders"), "o_orderpriority")


def _agg_query(name: str, sql_fn: str):
    @query(f"spec_{name.lower()}", f"SELECT o_orderpriority, round({sql_fn}(o_totalprice), 4) AS y FROM orders GROUP BY 1")
    def run(spark, sf_dir):
        return rounded(sp.spec_frame(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", name), "y")

    return run


for _name, _fn in (("AVG", "avg"), ("MEDIAN", "median"), ("MIN", "min"), ("MAX", "max")):
    _agg_query(_name, _fn)


@query("spec_sum", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def spec_sum(spark, sf_dir):
    return rounded(sp.spec_frame(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "SUM"), "y", digits=2)


@query("spec_raw", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def spec_raw(spark, sf_dir):
    return sp.spec_frame(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "NONE")


@query("spec_color_group", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS y FROM lineitem GROUP BY 1, 2""")
def spec_color_group(spark, sf_dir):
    return rounded(sp.spec_frame(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "AVG", color="l_linestatus"), "y")


@query("spec_sorted", """
SELECT c_mktsegment, round(avg(c_acctbal), 4) AS y, row_number() OVER (ORDER BY avg(c_acctbal), c_mktsegment) AS place FROM customer GROUP BY 1""")
def spec_sorted(spark, sf_dir):
    ordered = sp.spec_frame(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "AVG", sort_order="asc")
    # the rows of one partition are numbered as they come, so the query checks the order of the frame itself
    return rounded(ordered.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1), "y")


@query("spec_top_k", """
SELECT l_partkey, round(sum(l_quantity), 4) AS y FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 10""")
def spec_top_k(spark, sf_dir):
    return rounded(sp.spec_frame(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", "SUM", sort_order="desc", limit=10), "y")


def _time_query(unit: str):
    @query(f"spec_by_{unit}", f"SELECT date_trunc('{unit}', o_orderdate) AS o_orderdate, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
    def run(spark, sf_dir):
        return rounded(sp.spec_frame(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "SUM", time_unit=unit), "y", digits=2)

    return run


for _unit in ("day", "month", "year"):
    _time_query(_unit)


# ---------------------------------------------------------------- SQL specs

def _cleaned_orders(spark, sf_dir):
    return register(table(spark, sf_dir, "orders"), CLEAN_VIEW)


_SPEC_SQL = """SELECT "o_orderpriority", date_trunc('year', "o_orderdate") AS year, COUNT(*) AS n
FROM cleaned_data WHERE "o_orderstatus" <> 'no "P"' GROUP BY "o_orderpriority", date_trunc('year', "o_orderdate")"""


@query("spec_sql", _SPEC_SQL.replace("cleaned_data", "orders"))
def spec_sql(spark, sf_dir):
    _cleaned_orders(spark, sf_dir)
    return sp.run_sql(spark, _SPEC_SQL)


@query("spec_histogram", _histogram_sql("orders", "o_totalprice"))
def spec_histogram(spark, sf_dir):
    _cleaned_orders(spark, sf_dir)
    result = sp.run_sql(spark, 'SELECT "o_totalprice" FROM cleaned_data WHERE "o_totalprice" IS NOT NULL')
    return rounded(sp.render_data(result, {"chart_type": "histogram", "x_column": "o_totalprice"}), "bin_lo", "bin_hi")


@query("spec_heatmap", _matrix_sql(PRICED_SQL, _PRICED, False))
def spec_heatmap(spark, sf_dir):
    register(priced_lineitem(spark, sf_dir), CLEAN_VIEW)
    result = sp.run_sql(spark, f"SELECT {', '.join(_PRICED)}, l_returnflag FROM cleaned_data")
    return rounded(sp.render_data(result, {"chart_type": "heatmap"}), "r", "shown", digits=6)


@query("result_preview", """
WITH g AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT concat('Result shape: ', count(*), ' rows × 2 columns', chr(10), 'First rows:', chr(10), '[',
  string_agg(concat('{"o_orderpriority":"', p, '","y":', n, '}'), concat(',', chr(10), ' ') ORDER BY p), ']') AS preview FROM g""")
def result_preview(spark, sf_dir):
    return sp.result_preview(sp.spec_frame(table(spark, sf_dir, "orders"), "o_orderpriority"), ["o_orderpriority"])


# ---------------------------------------------------------------- planning

_PLAN_SQL = f"""
WITH d AS (SELECT abs(skewness(n_chars)) > 1 AS skewed, (SELECT n_outside FROM ({_outlier_sql("documents", "n_chars")})) AS out_ FROM documents),
e AS (SELECT abs(skewness(user_id)) > 1 AS skewed, (SELECT n_outside FROM ({_outlier_sql("events", "user_id")})) AS out_ FROM events),
f AS (SELECT 'documents' AS t, 'lang' AS c, 'n_chars' AS v, CAST(NULL AS VARCHAR) AS w, skewed, out_, (SELECT count(DISTINCT lang) FROM documents) AS u FROM d
      UNION ALL SELECT 'events', 'event_type', 'user_id', 'ts', skewed, out_, (SELECT count(DISTINCT event_type) FROM events) FROM e),
g AS (SELECT *, CASE WHEN skewed THEN 'MEDIAN' ELSE 'AVG' END AS agg, CASE WHEN skewed THEN 'Median' ELSE 'Average' END AS word,
      CASE WHEN u > 10 THEN ' LIMIT 10' ELSE '' END AS top, CASE WHEN out_ > 0 THEN concat(' It has ', out_, ' unusual values.') ELSE '' END AS note FROM f)
SELECT t AS table_name, concat('Number of rows by ', c) AS title, 'bar' AS chart_type, 'COUNT' AS aggregation,
  concat('SELECT "', c, '" , COUNT(*) AS n FROM cleaned_data GROUP BY "', c, '" ORDER BY n DESC', top) AS sql_query,
  concat('Shows how many rows each ', c, ' has.') AS explanation FROM g
UNION ALL SELECT t, concat('Distribution of ', v), 'histogram', 'NONE', concat('SELECT "', v, '" FROM cleaned_data WHERE "', v, '" IS NOT NULL'),
  concat('Shows how often each range of ', v, ' occurs.', note) FROM g
UNION ALL SELECT t, concat(word, ' ', v, ' by ', c), 'bar', agg,
  concat('SELECT "', c, '", ', agg, '("', v, '") AS result FROM cleaned_data GROUP BY "', c, '" ORDER BY result DESC', top),
  concat('Compares ', v, ' between the values of ', c, '.', note) FROM g
UNION ALL SELECT t, concat('Rows per month of ', w), 'line', 'COUNT',
  concat('SELECT date_trunc(''month'', "', w, '") AS month, COUNT(*) AS n FROM cleaned_data GROUP BY date_trunc(''month'', "', w, '") ORDER BY month'),
  concat('Shows the number of rows in each month of ', w, '.') FROM g WHERE w IS NOT NULL"""


def _profile(spark, sf_dir, name):
    return pf.column_profile(pinned_stats(table(spark, sf_dir, name), outlier_k=DEFAULT.profile_iqr))


@query("planned_specs", _PLAN_SQL)
def planned_specs(spark, sf_dir):
    return union([sp.plan_specs(_profile(spark, sf_dir, t)).select(
        F.lit(t).alias("table_name"), "title", "chart_type", "aggregation", "sql_query",
        F.col("plain_language_explanation").alias("explanation")) for t in ("documents", "events")])


_EVENT_TITLES = ("Number of rows by event_type", "Distribution of user_id", "Average user_id by event_type", "Rows per month of ts")


def _event_specs(spark, sf_dir, broken: tuple[str, ...] = ()):
    """The planned specs of events; those with a title in ``broken`` name a column that does not exist."""
    register(table(spark, sf_dir, "events"), CLEAN_VIEW)
    rows = [r.asDict() for r in sp.plan_specs(_profile(spark, sf_dir, "events")).orderBy("pos").collect()]
    return [{**r, "sql_query": 'SELECT "nope" FROM cleaned_data'} if r["title"] in broken else r for r in rows]


@query("spec_bind_check", f"SELECT title, title <> 'Distribution of user_id' AS ok FROM ({_PLAN_SQL}) WHERE table_name = 'events'")
def spec_bind_check(spark, sf_dir):
    return sp.bind_check(spark, _event_specs(spark, sf_dir, ("Distribution of user_id",))).select("title", "ok")


@query("merged_catalogue", _EVENTS_CHARTS + """
SELECT 'llm' AS source, 0 AS ord, 'Number of rows by event_type' AS title UNION ALL SELECT 'llm', 1, 'Rows per month of ts'
UNION ALL SELECT 'fallback', ord, title FROM n WHERE ord <= 6""")
def merged_catalogue(spark, sf_dir):
    """Two of four specs fail, so all rule-based charts follow."""
    broken = ("Distribution of user_id", "Average user_id by event_type")
    results, errors = sp.run_specs(spark, _event_specs(spark, sf_dir, broken))
    own = spark.createDataFrame([(i, s["title"]) for i, (s, _) in enumerate(results)], "ord bigint, title string")
    return sp.merge_catalogues(own, ct.chart_catalogue(table(spark, sf_dir, "events")))


@query("dashboard_charts", f"SELECT 'llm' AS source, title FROM ({_PLAN_SQL}) WHERE table_name = 'events'")
def dashboard_charts(spark, sf_dir):
    board = build_dashboard(spark, table(spark, sf_dir, "events"))
    return spark.createDataFrame([(c.source, c.title) for c in board.charts], "source string, title string")


@query("dashboard_rows", f"""
SELECT 'Number of rows by event_type' AS title, event_type AS key, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type
UNION ALL SELECT 'Distribution of user_id', CAST(bin AS VARCHAR), CAST(n AS DOUBLE) FROM ({_histogram_sql("events", "user_id")})
UNION ALL SELECT 'Average user_id by event_type', event_type, round(avg(user_id), 4) FROM events GROUP BY event_type
UNION ALL SELECT 'Rows per month of ts', strftime(date_trunc('month', ts), '%Y-%m'), count(*) FROM events GROUP BY date_trunc('month', ts)""")
def dashboard_rows(spark, sf_dir):
    """What every chart of the one-call run over events shows."""
    charts = build_dashboard(spark, table(spark, sf_dir, "events")).charts
    key = {"Distribution of user_id": ("bin", "n"), "Rows per month of ts": ("date_format(month, 'yyyy-MM')", "n"),
           "Average user_id by event_type": ("event_type", "round(result, 4)")}
    return union([c.data.selectExpr(f"'{c.title}' AS title", f"CAST({k} AS STRING) AS key", f"CAST({v} AS DOUBLE) AS value")
                  for c in charts for k, v in [key.get(c.title, ("event_type", "n"))]])


@query("planned_scatter", f"""
SELECT concat(x, ' and ', y) AS title, 'scatter' AS chart_type,
  concat('SELECT "', x, '", "', y, '" FROM cleaned_data WHERE "', x, '" IS NOT NULL AND "', y, '" IS NOT NULL') AS sql_query
FROM (SELECT 'net' AS x, 'gross' AS y, corr(net, gross) AS r FROM {PRICED_SQL}
      UNION ALL SELECT 'l_extendedprice', 'net', corr(l_extendedprice, net) FROM {PRICED_SQL}
      UNION ALL SELECT 'l_extendedprice', 'gross', corr(l_extendedprice, gross) FROM {PRICED_SQL}) ORDER BY r DESC LIMIT 1""")
def planned_scatter(spark, sf_dir):
    """The strongest pair of numeric columns becomes a scatter spec."""
    df = priced_lineitem(spark, sf_dir).select("l_extendedprice", "net", "gross")
    pairs = cd.correlations(df, [("l_extendedprice", "net"), ("l_extendedprice", "gross"), ("net", "gross")])
    plan = sp.plan_specs(pf.column_profile(pinned_stats(df, outlier_k=DEFAULT.profile_iqr)), pairs)
    return plan.where("chart_type = 'scatter'").select("title", "chart_type", "sql_query")


_MEDIAN_SQL = 'SELECT "o_orderstatus", MEDIAN("o_totalprice") AS result FROM cleaned_data GROUP BY "o_orderstatus" ORDER BY result DESC LIMIT 10'


@query("spec_planned_median", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS result FROM orders GROUP BY 1")
def spec_planned_median(spark, sf_dir):
    """A MEDIAN statement as planning writes it, on groups that hold most rows; bracketed, not gathered."""
    _cleaned_orders(spark, sf_dir)
    return rounded(sp.run_sql(spark, _MEDIAN_SQL), "result")


# ---------------------------------------------------------------- bulk validation: one spec per order
# The same expressions in both engines turn every order into a spec; months and days vary lengths and texts.

_SPEC_FIELDS = {
    "title": "repeat('x', month(o_orderdate) * 8 - 7)",
    "chart_type": """CASE WHEN o_totalprice > 400000 THEN 'pie' WHEN o_orderpriority = '1-URGENT' THEN 'bar'
        WHEN o_orderpriority = '2-HIGH' THEN 'line' WHEN o_orderpriority = '3-MEDIUM' THEN 'histogram'
        WHEN o_orderpriority = '5-LOW' THEN 'heatmap' ELSE 'scatter' END""",
    "business_question": "repeat('q', day(o_orderdate) * 8)",
    "sql_query": """CASE month(o_orderdate) WHEN 1 THEN concat('SELECT a FROM cleaned_data WHERE b = ', o_orderkey)
        WHEN 2 THEN ' select a from cleaned_data' WHEN 3 THEN 'DROP TABLE cleaned_data' WHEN 4 THEN 'SELECT a FROM other'
        WHEN 5 THEN 'SELECT a FROM  cleaned_data' WHEN 6 THEN 'SELECT updated FROM cleaned_data'
        WHEN 7 THEN 'SELECT a FROM cleaned_data; DELETE FROM cleaned_data' WHEN 8 THEN 'SELECT ''drop'' FROM cleaned_data'
        WHEN 9 THEN 'WITH t AS (SELECT 1) SELECT * FROM cleaned_data' WHEN 10 THEN NULL ELSE concat('SELECT ', o_orderstatus, ' FROM cleaned_data') END""",
    "x_column": "CASE WHEN o_totalprice < 250000 THEN 'a' END",
    "y_column": "CASE WHEN month(o_orderdate) <= 6 THEN 'b' END",
    "color_column": "CASE WHEN o_orderstatus = 'P' THEN 'c' END",
    "aggregation": "CASE o_orderstatus WHEN 'F' THEN 'COUNT' WHEN 'O' THEN 'NONE' ELSE 'MODE' END",
    "sort_order": "CASE WHEN day(o_orderdate) <= 8 THEN 'asc' WHEN day(o_orderdate) <= 16 THEN 'desc' WHEN day(o_orderdate) <= 24 THEN 'none' "
                  "WHEN day(o_orderdate) <= 28 THEN 'up' END",
    "limit": "CASE WHEN day(o_orderdate) < 31 THEN CAST(day(o_orderdate) * 2 - 1 AS INTEGER) END",
    "x_label": "CASE WHEN o_orderstatus = 'F' THEN repeat('l', month(o_orderdate) * 6) END",
    "y_label": "repeat('m', day(o_orderdate) * 3)",
    "plain_language_explanation": "repeat('e', day(o_orderdate) * 12)",
}
_SPECS_SQL = f"""(SELECT o_orderkey, o_custkey, {', '.join(f'{e} AS "{n}"' for n, e in _SPEC_FIELDS.items())} FROM orders)"""


def _specs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", *[f"{e} AS `{n}`" for n, e in _SPEC_FIELDS.items()])


def _out(found):
    return F.array_join(found, ",").alias("violations")


_BAD_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE"]
_SQL_RULES = "concat_ws(',', " + ", ".join(
    ["CASE WHEN sql_query IS NULL OR NOT starts_with(upper(trim(sql_query)), 'SELECT') THEN 'sql_not_select' END"]
    + [f"CASE WHEN regexp_matches(upper(sql_query), '\\b{w}\\b') THEN 'sql_{w.lower()}' END" for w in _BAD_WORDS]
    + ["CASE WHEN sql_query IS NULL OR NOT contains(upper(sql_query), 'FROM CLEANED_DATA') THEN 'sql_source' END"]) + ")"
_FIELD_RULES = """concat_ws(',', CASE WHEN length(title) NOT BETWEEN 3 AND 80 THEN 'title_length' END,
  CASE WHEN chart_type NOT IN ('bar','line','scatter','histogram','heatmap','box') THEN 'chart_type' END,
  CASE WHEN length(business_question) NOT BETWEEN 10 AND 200 THEN 'business_question_length' END,
  CASE WHEN aggregation NOT IN ('COUNT','AVG','SUM','MEDIAN','MIN','MAX','NONE') THEN 'aggregation' END,
  CASE WHEN sort_order NOT IN ('asc','desc','none') THEN 'sort_order' END,
  CASE WHEN "limit" NOT BETWEEN 2 AND 50 THEN 'limit' END,
  CASE WHEN length(x_label) > 60 THEN 'x_label_length' END, CASE WHEN length(y_label) > 60 THEN 'y_label_length' END,
  CASE WHEN length(plain_language_explanation) NOT BETWEEN 20 AND 300 THEN 'plain_language_explanation_length' END)"""
_CROSS_RULES = """concat_ws(',', CASE WHEN chart_type = 'histogram' AND y_column IS NOT NULL THEN 'histogram_has_y' END,
  CASE WHEN chart_type = 'histogram' AND x_column IS NULL THEN 'histogram_without_x' END,
  CASE WHEN chart_type = 'scatter' AND (x_column IS NULL OR y_column IS NULL) THEN 'scatter_without_axes' END,
  CASE WHEN chart_type = 'heatmap' AND (x_column IS NOT NULL OR y_column IS NOT NULL) THEN 'heatmap_has_axes' END,
  CASE WHEN chart_type IN ('scatter','histogram') AND aggregation <> 'NONE' THEN 'raw_chart_aggregates' END,
  CASE WHEN chart_type IN ('bar','line') AND aggregation = 'NONE' THEN 'bar_or_line_without_aggregate' END,
  CASE WHEN chart_type = 'line' AND sort_order IN ('asc','desc') THEN 'line_is_sorted' END)"""


@query("spec_sql_rules", f"SELECT o_orderkey, {_SQL_RULES} AS violations FROM {_SPECS_SQL}")
def spec_sql_rules(spark, sf_dir):
    return _specs(spark, sf_dir).select("o_orderkey", _out(sp.sql_violations()))


@query("spec_rules", f"SELECT o_orderkey, {_CROSS_RULES} AS violations FROM {_SPECS_SQL}")
def spec_rules(spark, sf_dir):
    return _specs(spark, sf_dir).select("o_orderkey", _out(sp.cross_field_violations()))


@query("spec_field_rules", f"SELECT o_orderkey, {_FIELD_RULES} AS violations FROM {_SPECS_SQL}")
def spec_field_rules(spark, sf_dir):
    return _specs(spark, sf_dir).select("o_orderkey", _out(sp.field_violations()))


@query("spec_validation", f"""
SELECT o_orderkey, concat_ws(',', nullif({_FIELD_RULES}, ''), nullif({_SQL_RULES}, ''), nullif({_CROSS_RULES}, '')) AS violations FROM {_SPECS_SQL}""")
def spec_validation(spark, sf_dir):
    return sp.validate_specs(_specs(spark, sf_dir)).select("o_orderkey", _out("violations"))


@query("spec_batch_size", "SELECT o_custkey, count(*) AS n_specs, count(*) BETWEEN 3 AND 5 AS size_ok FROM orders GROUP BY 1")
def spec_batch_size(spark, sf_dir):
    return sp.batch_sizes(_specs(spark, sf_dir), "o_custkey")


# ---------------------------------------------------------------- response parsing: one response per customer

def _wrapped(body: str) -> str:
    return f"""CASE WHEN c_nationkey < 5 THEN concat('```json\\n', {body}, '\\n```') WHEN c_nationkey < 10 THEN {body}
      WHEN c_nationkey < 15 THEN concat('```', {body}, '```') WHEN c_nationkey < 20 THEN substring({body}, 1, length({body}) - 1)
      ELSE '{{"other": "none"}}' END"""


def _responses(spark, sf_dir):
    """Model responses, fenced, bare, cut off or of another shape, as JSON of three specs about each customer."""
    one = """named_struct('title', concat({0}, c_name), 'chart_type', {1}, 'business_question', concat('What about ', c_name, '?'),
      'sql_query', concat('SELECT ', {2}, ' FROM cleaned_data'), 'x_column', 'a', 'y_column', CASE WHEN {1} = 'bar' THEN 'n' END,
      'aggregation', CASE WHEN {1} = 'bar' THEN 'COUNT' ELSE 'NONE' END, 'limit', c_nationkey + 2,
      'plain_language_explanation', concat('This is about the segment ', c_mktsegment))"""
    charts = ", ".join(one.format(*a) for a in (("'A '", "'bar'", "'a'"), ("CASE WHEN c_acctbal < 0 THEN repeat('z', 90) ELSE 'B ' END",
                                                                          "'histogram'", "'b'"), ("'C '", "'bar'", "'c'")))
    body = f"to_json(named_struct('charts', array({charts})))"
    # a customer is a few bytes in the file, so that a split holds millions, but its response takes long to write and parse
    dealt = table(spark, sf_dir, "customer").repartition(3 * spark.sparkContext.defaultParallelism, "c_custkey")
    return dealt.selectExpr("c_custkey", f"{_wrapped(body)} AS response")


_PARSED_SQL = """(SELECT c_custkey, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN concat('A ', c_name) WHEN 2 THEN concat('C ', c_name)
    ELSE concat(CASE WHEN c_acctbal < 0 THEN repeat('z', 90) ELSE 'B ' END, c_name) END AS title,
  CASE WHEN p = 1 THEN 'histogram' ELSE 'bar' END AS chart_type, concat('SELECT ', CASE p WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, ' FROM cleaned_data') AS sql_query,
  CASE WHEN p <> 1 THEN 'n' END AS y_column, CAST(c_nationkey + 2 AS INTEGER) AS "limit", c_acctbal
  FROM customer, (SELECT unnest(range(3)) AS p) WHERE c_nationkey < 15)"""


@query("parse_spec_responses", f"""SELECT c_custkey, pos, title, chart_type, sql_query, y_column, "limit" FROM {_PARSED_SQL}""")
def parse_spec_responses(spark, sf_dir):
    return sp.parse_responses(_responses(spark, sf_dir), "c_custkey", "response").select(
        "c_custkey", "pos", "title", "chart_type", "sql_query", "y_column", "limit")


@query("accepted_responses", f"SELECT c_custkey, pos, title FROM {_PARSED_SQL} WHERE c_acctbal >= 0")
def accepted_responses(spark, sf_dir):
    """A response counts only if all its specs are valid."""
    return sp.accept_responses(_responses(spark, sf_dir), "c_custkey", "response").select("c_custkey", "pos", "title")


@query("parse_insights", """
SELECT c_custkey, CAST(p AS INTEGER) AS pos, concat(chr(CAST(97 + p AS INTEGER)), ' ', c_name) AS insight
FROM customer, (SELECT unnest(range(7)) AS p)
WHERE (c_nationkey < 5 AND p < 2) OR (c_nationkey BETWEEN 5 AND 14 AND p < 5)""")
def parse_insights(spark, sf_dir):
    """Objects with two texts and a number, bare arrays with seven texts, cut-off texts, and other shapes."""
    letters = ", ".join(f"concat('{c} ', c_name)" for c in "abcdefg")
    listed = f"to_json(array({letters}))"
    held = "concat('{\"insights\": [', to_json(concat('a ', c_name)), ', 7, ', to_json(concat('b ', c_name)), ']}')"
    held = held.replace("to_json(concat('a ', c_name))", "concat('\"a ', c_name, '\"')").replace(
        "to_json(concat('b ', c_name))", "concat('\"b ', c_name, '\"')")
    body = f"CASE WHEN c_nationkey < 5 THEN {held} ELSE {listed} END"
    responses = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_wrapped('(' + body + ')')} AS response")
    return sp.parse_insights(responses, "c_custkey", "response")
