"""Rule-based chart data, column roles and the chart catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import chart_data as cd
from tablelens.operators.column_stats import pinned_stats
from tablelens.plans import catalogue as ct
from workload.common import (
    DOCS_SQL, LINEITEM_SQL, ORDERS_SQL, PRICED_SQL, dirty_lineitem, dirty_orders, labelled_documents, priced_lineitem, query, rounded, table,
    union, union_sql,
)
from workload.profile import _KINDS

_PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]


# ---------------------------------------------------------------- roles

_NAME_SQL = r"'^id$|_id$|^uuid|^index$|^row_?num|^key$|^record_?id|^pk$'"


def _identifier_sql(t: str, c: str, k: str) -> str:
    near = f"OR count(DISTINCT {c}) / greatest(count({c}), 1) > 0.95" if k == "i" else ""
    return (f"SELECT '{t}' AS table_name, '{c}' AS \"column\", regexp_matches('{c}', {_NAME_SQL}) {near} AS identifier FROM {t}"
            + (" GROUP BY ALL" if not near else ""))


_ROLE_TABLES = ("customer", "orders", "events", "documents", "embeddings")


@query("chart_identifiers", "SELECT DISTINCT * FROM (" + union_sql(
    [_identifier_sql(t, c, k) for t in _ROLE_TABLES for c, k in _KINDS[t].items()]) + ")")
def chart_identifiers(spark, sf_dir):
    return union([pinned_stats(table(spark, sf_dir, t), exact_quartiles=False).select(
        F.lit(t).alias("table_name"), "column", ct.identifier_test().alias("identifier")) for t in _ROLE_TABLES])


def _role_sql(t: str, c: str, k: str) -> str:
    kind = {"i": "numeric", "d": "numeric", "s": "categorical", "o": "other"}.get(k)
    if k == "t":
        return f"SELECT '{t}' AS table_name, '{c}' AS \"column\", 'datetime' AS role, count(*) AS rows FROM {t}"
    near = f"OR count(DISTINCT {c}) / greatest(count({c}), 1) > 0.95" if k == "i" else ""
    return f"""
SELECT '{t}' AS table_name, '{c}' AS "column", CASE WHEN regexp_matches('{c}', {_NAME_SQL}) {near} THEN 'identifier'
  WHEN 1 - count({c}) / count(*) > 0.4 THEN 'sparse' ELSE '{kind}' END AS role, count(*) AS rows FROM {t}"""


_DOCS_KINDS = {"doc_id": "i", "text": "s", "lang": "s", "source": "s", "n_chars": "i", "quality": "i", "toxic": "i", "lang_some": "s"}


@query("column_roles", union_sql(
    [_role_sql(t, c, k) for t in ("customer", "orders", "events", "embeddings") for c, k in _KINDS[t].items()]
    + [_role_sql(DOCS_SQL, c, k).replace(f"'{DOCS_SQL}' AS table_name", "'labelled' AS table_name") for c, k in _DOCS_KINDS.items()]))
def column_roles(spark, sf_dir):
    frames = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "events", "embeddings")}
    frames["labelled"] = labelled_documents(spark, sf_dir)
    out = []
    for t, df in frames.items():
        stats = pinned_stats(df)
        roles = ct.column_roles(stats).select("column", "role").join(stats.select("column", "rows"), "column")
        out.append(roles.select(F.lit(t).alias("table_name"), "column", "role", "rows"))
    return union(out)


@query("numeric_interest", """
SELECT "column", row_number() OVER (ORDER BY std DESC, pos) AS interest, round(std, 4) AS std FROM (
  SELECT 0 AS pos, 'p_size' AS "column", stddev_samp(p_size) AS std FROM part
  UNION ALL SELECT 1, 'p_retailprice', stddev_samp(p_retailprice) FROM part)""")
def numeric_interest(spark, sf_dir):
    roles = ct.column_roles(pinned_stats(table(spark, sf_dir, "part")))
    return rounded(roles.where("role = 'numeric'").select("column", "interest", "std"), "std")


def _bounds_sql(t: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""
SELECT '{c}' AS "column", round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper,
  n >= 4 AND (mn < q1 - 1.5 * (q3 - q1) OR mx > q3 + 1.5 * (q3 - q1)) AS has_outliers
FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, min({x}) AS mn, max({x}) AS mx, count({c}) AS n FROM {t})"""


_BOUNDED = [("events", "value"), ("documents", "n_chars"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice")]


@query("has_outliers", union_sql([f"SELECT \"column\", has_outliers FROM ({_bounds_sql(t, c)})" for t, c in _BOUNDED]))
def has_outliers(spark, sf_dir):
    return union([pinned_stats(table(spark, sf_dir, t).select(c), distinct="approx").select(
        "column", cd.has_outliers().alias("has_outliers")) for t, c in _BOUNDED])


@query("outlier_bounds", union_sql([f"SELECT \"column\", lower, upper FROM ({_bounds_sql(t, c)})" for t, c in _BOUNDED]))
def outlier_bounds(spark, sf_dir):
    found = [(c, *cd.outlier_bounds(table(spark, sf_dir, t), [c])[c]) for t, c in _BOUNDED]
    return rounded(spark.createDataFrame(found, "column string, lower double, upper double"), "lower", "upper")


@query("datetime_columns", union_sql([f"""
SELECT '{c}' AS "column", count({p}) / count({c}) >= 0.8 AS is_datetime FROM {ORDERS_SQL}""" for c, p in (
    ("o_orderstatus", "TRY_STRPTIME(o_orderstatus, '%Y-%m-%d')"), ("o_orderpriority", "TRY_STRPTIME(o_orderpriority, '%Y-%m-%d')"),
    ("o_orderdate", "o_orderdate"), ("date_iso", "TRY_STRPTIME(date_iso, '%Y-%m-%d')"),
    ("date_us", "TRY_STRPTIME(date_us, '%m/%d/%Y')"))]))
def datetime_columns(spark, sf_dir):
    df = dirty_orders(spark, sf_dir).select("o_orderstatus", "o_orderpriority", "o_orderdate", "date_iso", "date_us")
    return pinned_stats(df, distinct="approx", exact_quartiles=False).select("column", ct.datetime_test().alias("is_datetime"))


# ---------------------------------------------------------------- R00, R12, R01, R02, R03, R11

@query("r00_summary", """
SELECT t.type, t.n_columns, (SELECT count(*) FROM lineitem) AS rows, CAST(11 AS BIGINT) AS columns
FROM (VALUES ('bigint', CAST(3 AS BIGINT)), ('int', 1), ('double', 4), ('string', 2), ('timestamp_ntz', 1)) t(type, n_columns)""")
def r00_summary(spark, sf_dir):
    return cd.dtype_counts(table(spark, sf_dir, "lineitem"))


@query("r00_columns", f"""
SELECT CAST(ord AS INTEGER) AS ord, column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE'
  THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type, CAST(n - 20 AS INTEGER) AS more
FROM (SELECT *, row_number() OVER () - 1 AS ord, count(*) OVER () AS n FROM (DESCRIBE SELECT * FROM {LINEITEM_SQL})) WHERE ord < 20""")
def r00_columns(spark, sf_dir):
    """The columns that the overview names, of a table with more than twenty."""
    return cd.first_columns(dirty_lineitem(spark, sf_dir))


@query("r12_missingness", f"""
SELECT "column", round(pct, 4) AS missing_pct, CASE WHEN pct > 40 THEN 'red' WHEN pct > 10 THEN 'amber' ELSE 'grey' END AS tier
FROM ({union_sql([f"SELECT '{c}' AS {chr(34)}column{chr(34)}, 100 * (1 - count({c}) / count(*)) AS pct FROM {DOCS_SQL}" for c in _DOCS_KINDS])})
WHERE pct > 0""")
def r12_missingness(spark, sf_dir):
    stats = pinned_stats(labelled_documents(spark, sf_dir), distinct="approx", exact_quartiles=False, text_rules=False)
    return rounded(cd.missing_tiers(stats).select("column", "missing_pct", "tier"), "missing_pct")


def _histogram_sql(t: str, c: str, extra: str = "") -> str:
    return f"""
SELECT b AS bin, round(lo + b * (hi - lo) / 30, 4) AS bin_lo, round(lo + (b + 1) * (hi - lo) / 30, 4) AS bin_hi, coalesce(n, 0) AS n {extra}
FROM (SELECT unnest(range(30)) AS b), (SELECT min({c}) AS lo, max({c}) AS hi FROM {t})
LEFT JOIN (SELECT CAST(least(floor(({c} - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n
           FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}) WHERE {c} IS NOT NULL GROUP BY 1) ON bin = b"""


@query("r01_histogram", _histogram_sql("lineitem", "l_extendedprice"))
def r01_histogram(spark, sf_dir):
    return rounded(cd.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "bin_lo", "bin_hi")


@query("r02_histogram_outliers", f"""
SELECT h.bin, h.bin_lo, h.bin_hi, h.n, o.lower, o.upper, h.hi_ < o.lo_ OR h.lo_ > o.up_ AS outside
FROM ({_histogram_sql("events", "value", ", lo + b * (hi - lo) / 30 AS lo_, lo + (b + 1) * (hi - lo) / 30 AS hi_")}) h,
(SELECT round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper, q1 - 1.5 * (q3 - q1) AS lo_, q3 + 1.5 * (q3 - q1) AS up_
 FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)) o""")
def r02_histogram_outliers(spark, sf_dir):
    return rounded(cd.histogram(table(spark, sf_dir, "events"), "value", outliers=True), "bin_lo", "bin_hi", "lower", "upper")


def _top_sql(t: str, columns: list[str]) -> str:
    melted = union_sql([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {t}" for c in columns])
    return f"""
SELECT "column", rank, value, n FROM (
  SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rank
  FROM ({melted}) WHERE value IS NOT NULL GROUP BY "column", value) WHERE rank <= 10"""


@query("r03_value_counts", _top_sql("lineitem", ["l_returnflag", "l_linestatus"]))
def r03_value_counts(spark, sf_dir):
    return cd.top_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("r11_top_n", _top_sql("part", ["p_name", "p_brand"]))
def r11_top_n(spark, sf_dir):
    return cd.top_values(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("r11_top_texts", _top_sql("documents", ["text", "source"]))
def r11_top_texts(spark, sf_dir):
    """Whole texts as values: almost every one differs."""
    return cd.top_values(table(spark, sf_dir, "documents"), ["text", "source"])


# ---------------------------------------------------------------- R07, R08

_SEASON = "make_timestamp_ntz(1996, month(o_orderdate), day(o_orderdate), 0, 0, 0)"
_SEASON_SQL = "(SELECT *, make_timestamp(1996, month(o_orderdate), day(o_orderdate), 0, 0, 0) AS season FROM orders)"


def _seasons(spark, sf_dir):
    """Orders by day of the year: a span between 60 and 730 days."""
    return table(spark, sf_dir, "orders").withColumn("season", F.expr(_SEASON))


_PERIOD = "CASE WHEN span_days > 730 THEN 'month' WHEN span_days > 60 THEN 'week' ELSE 'day' END"
_SPANS = [("orders", "o_orderdate", "orders"), ("seasons", "season", _SEASON_SQL), ("events", "ts", "events")]


@query("auto_period", union_sql([f"""
SELECT '{n}' AS name, span_days, {_PERIOD} AS period
FROM (SELECT CAST(floor(epoch(max({c}) - min({c})) / 86400) AS BIGINT) AS span_days FROM {t})""" for n, c, t in _SPANS]))
def auto_period(spark, sf_dir):
    frames = {"orders": table(spark, sf_dir, "orders"), "seasons": _seasons(spark, sf_dir), "events": table(spark, sf_dir, "events")}
    return union([frames[n].agg(F.timestamp_diff("DAY", F.min(c), F.max(c)).alias("span_days")).select(
        F.lit(n).alias("name"), "span_days", cd.auto_period().alias("period")) for n, c, _ in _SPANS])


@query("r07_records_over_time", union_sql([f"""
SELECT '{n}' AS name, date_trunc('{u}', {c}) AS period, count(*) AS n FROM {t} GROUP BY ALL"""
    for (n, c, t), u in zip(_SPANS, ("month", "week", "day"))]))
def r07_records_over_time(spark, sf_dir):
    frames = {"orders": table(spark, sf_dir, "orders"), "seasons": _seasons(spark, sf_dir), "events": table(spark, sf_dir, "events")}
    return union([cd.records_over_time(frames[n], c).select(F.lit(n).alias("name"), "period", "n") for n, c, _ in _SPANS])


@query("r08_avg_over_time", union_sql([f"""
SELECT '{n}' AS name, date_trunc('{u}', {c}) AS period, round(avg({v}), 4) AS mean FROM {t} GROUP BY ALL"""
    for (n, c, t), u, v in zip(_SPANS, ("month", "week", "day"), ("o_totalprice", "o_totalprice", "value"))]))
def r08_avg_over_time(spark, sf_dir):
    frames = {"orders": table(spark, sf_dir, "orders"), "seasons": _seasons(spark, sf_dir), "events": table(spark, sf_dir, "events")}
    values = {"orders": "o_totalprice", "seasons": "o_totalprice", "events": "value"}
    return rounded(union([cd.average_over_time(frames[n], c, values[n]).select(F.lit(n).alias("name"), "period", "mean")
                          for n, c, _ in _SPANS]), "mean")


@query("r07_text_dates", f"""
SELECT date_trunc('month', TRY_STRPTIME(date_iso, '%Y-%m-%d')) AS period, count(*) AS n FROM {ORDERS_SQL} GROUP BY ALL""")
def r07_text_dates(spark, sf_dir):
    """Date text is read leniently."""
    return cd.records_over_time(dirty_orders(spark, sf_dir), "date_iso")


# ---------------------------------------------------------------- R04

@query("r04_mean_by_category", """
SELECT o_orderpriority AS category, round(avg(o_totalprice), 4) AS result FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def r04_mean_by_category(spark, sf_dir):
    return rounded(cd.by_category(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"), "result")


@query("r04_median_by_category", """
SELECT event_type AS category, round(median(value), 4) AS result FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def r04_median_by_category(spark, sf_dir):
    return rounded(cd.by_category(table(spark, sf_dir, "events"), "value", "event_type", median=True), "result")


@query("r04_median_many_categories", """
SELECT CAST(l_partkey AS VARCHAR) AS category, round(median(l_extendedprice), 4) AS result FROM lineitem
GROUP BY 1 ORDER BY median(l_extendedprice) DESC, 1 LIMIT 10""")
def r04_median_many_categories(spark, sf_dir):
    return rounded(cd.by_category(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_partkey", median=True), "result")


# ---------------------------------------------------------------- R05, R06

def _pairs(cols):
    return [(x, y) for i, x in enumerate(cols) for y in cols[i + 1:]]


def _r_sql(x: str, y: str) -> str:
    return f"CASE WHEN NOT isnan(corr({x}, {y})) THEN corr({x}, {y}) END"


_PAIR_SQL = union_sql([
    f"SELECT {i} AS ord, '{x}' AS x, '{y}' AS y, count(*) AS n, {_r_sql(x, y)} AS r FROM {PRICED_SQL}"
    for i, (x, y) in enumerate(_pairs(_PRICED))])


@query("r05_pair_scan", f"SELECT x, y, n, round(r, 6) AS r FROM ({_PAIR_SQL}) WHERE abs(r) >= 0.4 AND n >= 10")
def r05_pair_scan(spark, sf_dir):
    return rounded(cd.strong_pairs(priced_lineitem(spark, sf_dir), _PRICED).select("x", "y", "n", "r"), "r", digits=6)


@query("r05_strongest_pair", f"SELECT x, y, round(r, 6) AS r FROM ({_PAIR_SQL}) WHERE abs(r) >= 0.4 AND n >= 10 ORDER BY abs(r) DESC, ord LIMIT 1")
def r05_strongest_pair(spark, sf_dir):
    return rounded(cd.strong_pairs(priced_lineitem(spark, sf_dir), _PRICED).limit(1).select("x", "y", "r"), "r", digits=6)


_SPARSE_PAIRS = [("doc_id", "n_chars"), ("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic")]


@query("r05_pairwise_complete", union_sql([
    f"SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, round({_r_sql(x, y)}, 6) AS r FROM {DOCS_SQL}"
    for x, y in _SPARSE_PAIRS]))
def r05_pairwise_complete(spark, sf_dir):
    """Pairs over their own complete rows, with columns that have nulls."""
    return rounded(cd.correlations(labelled_documents(spark, sf_dir), _SPARSE_PAIRS).select("x", "y", "n", "r"), "r", digits=6)


@query("r05_points", f"SELECT l_extendedprice AS x, net AS y FROM {PRICED_SQL} WHERE l_extendedprice IS NOT NULL AND net IS NOT NULL")
def r05_points(spark, sf_dir):
    return cd.scatter_points(priced_lineitem(spark, sf_dir), "l_extendedprice", "net")


@query("r05_density", f"""
WITH r AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(net AS DOUBLE) AS y FROM {PRICED_SQL} WHERE l_extendedprice IS NOT NULL AND net IS NOT NULL),
e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM r),
p AS (SELECT x, y, least(floor((x - lx) / (hx - lx) * 64), 63) AS cx, least(floor((y - ly) / (hy - ly) * 64), 63) AS cy FROM r, e),
c AS (SELECT cx, cy, count(*) AS n FROM p GROUP BY ALL)
SELECT 'cell' AS kind, round(lx + cx * ((hx - lx) / 64), 4) AS x, round(ly + cy * ((hy - ly) / 64), 4) AS y,
  round(lx + cx * ((hx - lx) / 64) + (hx - lx) / 64, 4) AS x_hi, round(ly + cy * ((hy - ly) / 64) + (hy - ly) / 64, 4) AS y_hi, n FROM c, e WHERE n > 3
UNION ALL SELECT 'point', round(x, 4), round(y, 4), round(x, 4), round(y, 4), count(*) FROM p JOIN c USING (cx, cy) WHERE n <= 3 GROUP BY x, y""")
def r05_density(spark, sf_dir):
    """The scatter as a grid of counts, with points where a cell is rare."""
    return rounded(cd.density(priced_lineitem(spark, sf_dir), "l_extendedprice", "net"), "x", "y", "x_hi", "y_hi")


@query("r05_trend", f"""
SELECT round(regr_slope(net, l_extendedprice), 6) AS slope, round(regr_intercept(net, l_extendedprice), 4) AS intercept,
  CAST(regr_count(net, l_extendedprice) AS BIGINT) AS n, min(l_extendedprice) AS x_min, max(l_extendedprice) AS x_max FROM {PRICED_SQL}""")
def r05_trend(spark, sf_dir):
    return rounded(rounded(cd.trend(priced_lineitem(spark, sf_dir), "l_extendedprice", "net"), "slope", digits=6), "intercept") \
        .withColumn("n", F.col("n").cast("bigint"))


@query("r05_trend_line", f"""
SELECT p AS point, round(lo + p * (hi - lo) / 99, 4) AS x, round(s * (lo + p * (hi - lo) / 99) + c, 4) AS y
FROM (SELECT unnest(range(100)) AS p), (SELECT regr_slope(net, l_extendedprice) AS s, regr_intercept(net, l_extendedprice) AS c,
  min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {PRICED_SQL})""")
def r05_trend_line(spark, sf_dir):
    return rounded(cd.trend_line(priced_lineitem(spark, sf_dir), "l_extendedprice", "net"), "x", "y")


@query("r05_t_stat", f"""
SELECT x, y, n, round(r * sqrt((n - 2) / (1 - r * r)), 2) AS t FROM ({_PAIR_SQL}) WHERE abs(r) >= 0.4""")
def r05_t_stat(spark, sf_dir):
    pairs = cd.with_significance(cd.strong_pairs(priced_lineitem(spark, sf_dir), _PRICED))
    return rounded(pairs.select("x", "y", "n", "t"), "t", digits=2)


@query("r05_p_value")
def r05_p_value(spark, sf_dir):
    pairs = cd.correlations(labelled_documents(spark, sf_dir), _SPARSE_PAIRS)
    return rounded(cd.with_significance(pairs).select("x", "y", "n", "p"), "p")


def _critical_sql(z: float) -> str:
    """The value that |t| exceeds with a given probability, by its expansion around the normal one."""
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return f"({z!r} + " + " + ".join(f"{c!r} / power(n - 2, {k})" for k, c in enumerate(terms, 1)) + ")"


# ---- fixed values: two-sided normal quantiles of 5 %, 1 % and 0.1 %
_NORMAL = (1.959963984540054, 2.5758293035489004, 3.2905267314918945)


@query("r05_significance", union_sql([
    f"SELECT x, y, n, CASE WHEN abs(t) > {_critical_sql(_NORMAL[2])} THEN 3 WHEN abs(t) > {_critical_sql(_NORMAL[1])} THEN 2 "
    f"WHEN abs(t) > {_critical_sql(_NORMAL[0])} THEN 1 ELSE 0 END AS stars FROM (SELECT '{x}' AS x, '{y}' AS y, "
    f"count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, {_r_sql(x, y)} * sqrt((n - 2) / (1 - power({_r_sql(x, y)}, 2))) AS t FROM {DOCS_SQL})"
    for x, y in _SPARSE_PAIRS]))
def r05_significance(spark, sf_dir):
    """The p-value as stars: under 5 %, 1 % and 0.1 %."""
    found = cd.with_significance(cd.correlations(labelled_documents(spark, sf_dir), _SPARSE_PAIRS))
    stars = sum((F.when(F.col("p") < p, 1).otherwise(0) for p in (0.05, 0.01, 0.001)), F.lit(0))
    return found.select("x", "y", "n", stars.alias("stars"))


def _matrix_sql(source: str, cols: list[str], mask: bool) -> str:
    shown = "CASE WHEN abs(r) >= 0.5 THEN round(r, 6) END" if mask else "round(r, 6)"
    cells = union_sql([f"SELECT '{x}' AS x, '{y}' AS y, {_r_sql(x, y)} AS r FROM {source}" for x in cols for y in cols])
    return f"SELECT x, y, round(r, 6) AS r, {shown} AS shown FROM ({cells})"


@query("r06_heatmap", _matrix_sql(PRICED_SQL, _PRICED, True))
def r06_heatmap(spark, sf_dir):
    return rounded(cd.heatmap(priced_lineitem(spark, sf_dir), _PRICED), "r", "shown", digits=6)


_LISTWISE_SQL = f"(SELECT * FROM {DOCS_SQL} WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL)"


@query("r06_heatmap_listwise", _matrix_sql(_LISTWISE_SQL, ["n_chars", "quality", "toxic"], True))
def r06_heatmap_listwise(spark, sf_dir):
    """Only rows complete in all columns count."""
    return rounded(cd.heatmap(labelled_documents(spark, sf_dir), ["n_chars", "quality", "toxic"]), "r", "shown", digits=6)


# ---------------------------------------------------------------- catalogue

def _rows_sql(rows: list[tuple], any_missing: str = "") -> str:
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
                                       for v in r) + ")" for r in rows)
    return f"SELECT CAST(p AS INTEGER) AS priority, CAST(o AS BIGINT) AS ord, rule, title, x, y FROM (VALUES {values}) t(p, o, rule, title, x, y)"


# Which rule applies follows from facts the SQL recomputes: outliers choose R01/R02, the spread orders the numerics.
_EVENTS_FACTS = f"""
facts AS (SELECT CASE WHEN (SELECT has_outliers FROM ({_bounds_sql("events", "value")})) THEN 'R02' ELSE 'R01' END AS shape,
  (SELECT count(DISTINCT event_type) FROM events) AS kinds, (SELECT count(DISTINCT props) FROM events) AS prop_kinds)"""
_EVENTS_CHARTS = f"""
WITH {_EVENTS_FACTS},
c AS (
  SELECT 1 AS priority, 'R00' AS rule, 'Dataset summary' AS title, CAST(NULL AS VARCHAR) AS x, CAST(NULL AS VARCHAR) AS y FROM facts
  UNION ALL SELECT 2, 'R07', 'Records over time: ts', 'ts', NULL FROM facts
  UNION ALL SELECT 3, 'R03', 'Count of ''event_type''', 'event_type', NULL FROM facts WHERE kinds <= 20
  UNION ALL SELECT 4, 'R08', 'Average ''value'' over time', 'ts', 'value' FROM facts
  UNION ALL SELECT 5, shape, 'Distribution: value', 'value', NULL FROM facts
  UNION ALL SELECT 6, 'R04', '''value'' by ''event_type''', 'event_type', 'value' FROM facts WHERE kinds BETWEEN 2 AND 20
  UNION ALL SELECT 9, 'R11', 'Counts: props (top 10)', 'props', NULL FROM facts WHERE prop_kinds > 20
  UNION ALL SELECT 11, 'R04', '''value'' by ''props'' (top 10)', 'props', 'value' FROM facts WHERE prop_kinds > 20),
n AS (SELECT CAST(priority AS INTEGER) AS priority, row_number() OVER (ORDER BY priority) AS ord, rule, title, x, y FROM c)
"""


@query("chart_catalogue", _EVENTS_CHARTS + "SELECT * FROM n WHERE ord <= 6")
def chart_catalogue(spark, sf_dir):
    return ct.chart_catalogue(table(spark, sf_dir, "events"))


@query("chart_pool", _EVENTS_CHARTS + "SELECT * FROM n")
def chart_pool(spark, sf_dir):
    return ct.chart_catalogue(table(spark, sf_dir, "events"), max_charts=None)


_PRICED_STD = union_sql([f"SELECT '{c}' AS c, stddev_samp({c}) AS std, {i} AS pos FROM {PRICED_SQL}"
                         for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + _PRICED)])


@query("chart_pool_pairs", f"""
WITH s AS (SELECT c, row_number() OVER (ORDER BY std DESC, pos) AS k FROM ({_PRICED_STD})),
p AS (SELECT x, y, row_number() OVER (ORDER BY abs(r) DESC, ord) AS k FROM ({_PAIR_SQL}) WHERE abs(r) >= 0.4)
SELECT 'R08' AS rule, concat('Average ''', c, ''' over time') AS title, 'l_shipdate' AS x, c AS y FROM s
UNION ALL SELECT 'R04', concat('''', c, ''' by ''', f, ''''), f, c FROM s, (VALUES ('l_returnflag'), ('l_linestatus')) t(f)
UNION ALL SELECT 'R05', concat('Scatter: ', x, ' vs ', y), x, y FROM p""")
def chart_pool_pairs(spark, sf_dir):
    """All pair charts of a table with ten numerics: over time, by category, and scatters."""
    pool = ct.chart_catalogue(priced_lineitem(spark, sf_dir), max_charts=None)
    return pool.where("rule IN ('R08', 'R04', 'R05')").select("rule", "title", "x", "y")
