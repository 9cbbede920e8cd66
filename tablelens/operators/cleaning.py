"""Screening and cleaning: decide per column from its statistics, then project a lazy cleaned table.

Decisions need one row per column on the driver; data rows never leave the executors, and none is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens import fixed_values as fv
from tablelens.config import DEFAULT, LensConfig
from tablelens.functions import text as tx
from tablelens.operators.column_stats import (
    NUMERIC_KINDS, column_stats, comparable, fences, hash_parts, text_ends,
)
from tablelens.operators.quantiles import exact_quantiles
from tablelens.sources.tables import CLEAN_VIEW, broadcast_if_small, cut_lineage, pin_small, register, without_nan


@dataclass
class Cleaned:
    table: DataFrame     # lazy cleaned projection
    report: DataFrame    # ord, severity, column, rule, issue, detail, n
    decisions: DataFrame  # one row per raw column: kept, action, counts behind it

    def register(self, name: str = CLEAN_VIEW) -> DataFrame:
        return register(self.table, name)


# ---------------------------------------------------------------- screening

def repeated_names(columns: list[str]) -> dict[str, str]:
    """Columns whose name, without a numeric .N suffix, was already taken: {column: base}."""
    taken: set[str] = set()
    repeated = {}
    for c in columns:
        base = re.sub(fv.DUPLICATE_NAME_SUFFIX, "", c)
        if base in taken:
            repeated[c] = base
        taken.add(base)
    return repeated


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls and rows per column, in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(tx.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"))
        for i, c in enumerate(df.columns)
    ])))


def sample_text(df: DataFrame, column: str, n: int = 200) -> DataFrame:
    """Up to n non-null values, the same ones on every run: the lowest by hash."""
    c = tx.col(column).cast("string")
    return df.where(c.isNotNull()).select(c.alias("value")).orderBy(F.xxhash64("value"), "value").limit(n)


def row_marks(df: DataFrame) -> list[Column]:
    """Two independent 64-bit fingerprints of a row."""
    parts = [tx.sql(p) for f in df.schema for p in hash_parts(tx.ident(f.name), f.dataType)]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (11, 23)]


def row_groups(df: DataFrame, cfg: LensConfig = DEFAULT, marks: Callable[[DataFrame], list[Column]] = row_marks) -> DataFrame:
    """One row: rows, distinct rows, extra copies, and groups that occur more than once, exactly.

    Rows are grouped by fingerprints, so the shuffle carries 24 bytes per row however wide the table is, and copies collapse before it. Only
    rows whose fingerprint occurs again are compared by their whole content, again combined before the shuffle.
    """
    marked = df.select(F.struct(*[tx.col(c) for c in df.columns]).alias("row"), *[m.alias(f"h{i}") for i, m in enumerate(marks(df))])
    counts = marked.select("h0", "h1").groupBy("h0", "h1").count()
    again = F.col("count") > 1
    # fingerprints that occur again, and one row (without a key) for all that do not: only these are kept
    kept = cut_lineage(counts.groupBy(F.when(again, F.col("h0")).alias("k0"), F.when(again, F.col("h1")).alias("k1")).agg(
        F.sum("count").alias("rows"), F.count(F.lit(1)).alias("marks")))
    repeated = kept.where("k0 IS NOT NULL").select("k0", "k1")
    known = kept.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.expr("CASE WHEN k0 IS NULL THEN marks END")), F.lit(0)).alias("single"),
                     F.count("k0").alias("several")).first()
    zero = F.lit(0).cast("bigint")
    if not known["several"]:
        return df.sparkSession.range(1).select(F.lit(known["rows"]).cast("bigint").alias("rows"), F.lit(known["single"]).cast("bigint").alias("distinct_rows"),
                                               zero.alias("duplicate_rows"), zero.alias("duplicate_groups"))
    copies = marked.join(broadcast_if_small(repeated, known["several"], cfg), (F.col("h0") == F.col("k0")) & (F.col("h1") == F.col("k1")), "left_semi")
    values = [tx.sql(comparable(f"row.{tx.ident(f.name)}", f.dataType)) for f in df.schema]
    compared = copies.groupBy(*[v.alias(f"v{i}") for i, v in enumerate(values)]).count()
    return compared.agg(
        F.lit(known["rows"]).cast("bigint").alias("rows"),
        (F.count(F.lit(1)) + F.lit(known["single"])).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("count") - 1), zero).alias("duplicate_rows"),
        F.count_if(F.col("count") > 1).alias("duplicate_groups"),
    )


# ---------------------------------------------------------------- decisions

def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def decide(stats: DataFrame, repeated: dict[str, str] | None = None, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Add kept, action and the rates behind it to a column-statistics table.

    action: duplicate, all_null, constant, pass, currency, currency_kept, number, mixed, date, mixed_dates, trim.
    """
    repeated = repeated or {}
    seen = F.col("rows") - F.col("nulls")
    whole = seen - F.col("sentinels") if cfg.exclude_sentinels else seen
    suffix = "_kept" if cfg.exclude_sentinels else ""
    rates = stats.select(
        "*",
        F.col("column").isin(*repeated).alias("is_repeat") if repeated else F.lit(False).alias("is_repeat"),
        _rate(F.col("currency_like"), whole).alias("currency_share"),
        _rate(F.col(f"currency_cast{suffix}"), whole).alias("cast_share"),
        _rate(F.col(f"number_like{suffix}"), whole).alias("number_share"),
        _rate(F.col("best_date"), whole).alias("date_share"),
        _rate(F.col("any_date"), whole).alias("any_date_share"),
        _rate(F.col("nulls"), F.col("rows")).alias("null_share"),
    )
    text = F.col("kind") == "string"
    some_rows = F.col("rows") > 0
    action = (
        F.when(F.col("is_repeat"), "duplicate")
        .when(some_rows & (F.col("nulls") == F.col("rows")), "all_null")
        .when(some_rows & F.col("single_value"), "constant")
        .when(~text | (seen == 0), "pass")
        .when((F.col("currency_share") >= cfg.currency_shape_rate) & (F.col("cast_share") >= cfg.numeric_rate), "currency")
        .when(F.col("currency_share") >= cfg.currency_shape_rate, "currency_kept")
        .when(F.col("number_share") >= cfg.numeric_rate, "number")
        .when(F.col("number_share") >= cfg.mixed_rate, "mixed")
        .when(F.col("date_share") >= cfg.date_rate, "date")
        .when(F.col("any_date_share") >= cfg.mixed_date_rate, "mixed_dates")
        .otherwise("trim")
    )
    decided = rates.withColumn("action", action)
    dropped = F.col("action").isin("duplicate", "all_null", "constant")
    return decided.withColumn("kept", ~dropped)


def _cleaned_column(r) -> str:
    """The SQL expression that turns a raw column into its cleaned form."""
    c = tx.ident(r["column"])
    if r["kind"] != "string":
        return c
    words = tx.blank_sentinels(c) if r["sentinels"] else c
    action = r["action"]
    if action == "currency":
        return tx.parse_currency(words)
    if action == "number":
        return tx.parse_grouped_number(words)
    if action == "date":
        return tx.parse_date(words, r["date_format"])
    return words if action in ("currency_kept", "pass") else f"trim({words})"


def project(df: DataFrame, decision_rows) -> DataFrame:
    kept = [r for r in decision_rows if r["kept"]]
    if not kept:  # a table always keeps its columns when none would remain
        kept = [r for r in decision_rows if r["action"] != "duplicate"]
    return df.selectExpr(*[f"{_cleaned_column(r)} AS {tx.ident(r['column'])}" for r in kept])


# ---------------------------------------------------------------- report


def _percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def column_findings(decided: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Report rows that follow from the decisions: rank, ord, column, rule, detail, n."""
    def finding(rule: str, when: Column, rank: int, detail: Column, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("rank"), "ord", "column", F.lit(rule).alias("rule"),
                                     detail.cast("string").alias("detail"), n.cast("bigint").alias("n")))

    act = F.col("action")
    text = F.col("kept") & (F.col("kind") == "string")
    any_seen = F.col("rows") > F.col("nulls")
    share = F.col("number_share")
    sampled_dates = _percent(F.col("any_date_share"))
    quoted = F.concat(F.lit("'"), "column", F.lit("'"))
    base = F.regexp_replace("column", fv.DUPLICATE_NAME_SUFFIX, "")
    found = [
        finding("duplicate_column", act == "duplicate", 0,
                F.concat(quoted, F.lit(" is a duplicate of '"), base, F.lit("'. Excluded from view.")), F.lit(None)),
        finding("all_null", act == "all_null", 1, F.lit("100% of values are NULL. No insight possible."),
                F.col("nulls")),
        finding("constant", act == "constant", 1,
                F.lit("Single unique value across all rows. No insight possible."), F.lit(1)),
        finding("sentinel", text & (F.col("sentinels") > 0), 2,
                F.concat(F.col("sentinels").cast("string"),
                         F.lit(" values like 'N/A', 'unknown', '-' replaced.")), F.col("sentinels")),
        finding("currency", act == "currency", 2,
                F.concat(F.lit("Example original value: '"), "min_text", F.lit("'")), F.col("currency_cast")),
        finding("number", act == "number", 2,
                F.concat(_percent(share), F.lit(" of sampled values are valid numbers.")), F.col("number_like")),
        finding("mixed", act == "mixed", 2,
                F.concat(_percent(share), F.lit(" of values look numeric, "), _percent(1 - share),
                         F.lit(" are text. Column kept as text. Avoid using as a numeric axis.")),
                F.col("number_like")),
        finding("date", act == "date", 2,
                F.lit("Column consistently contains dates and was converted."), F.col("best_date")),
        finding("mixed_dates", act == "mixed_dates", 2,
                F.concat(sampled_dates, F.lit(" of sampled values parsed as dates. Multiple formats likely. "
                                              "Column kept as text. Time-series charts may not work correctly.")),
                F.col("any_date")),
        finding("high_missing", act.isin("date", "mixed_dates", "trim") & any_seen
                & (F.col("null_share") > cfg.high_null_rate), 2,
                F.concat(_percent(F.col("null_share")),
                         F.lit(" of values are missing. Charts using this column may be misleading.")),
                F.col("nulls")),
    ]
    return (decided.select(F.posexplode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("step", "f"))
            .select("f.rank", "f.ord", "step", "f.column", "f.rule", "f.detail", "f.n"))


def extreme_outliers(df: DataFrame, columns: dict[str, str], cfg: LensConfig = DEFAULT,
                     ends: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Exact quartiles, 3-IQR fences, extremes and counts outside, for numeric SQL expressions with a spread.

    The extremes are the quantiles 0 and 1, so that one selection gives them with the quartiles; the counts take one more scan.
    ``ends`` are minima and maxima that are known already.
    """
    found = exact_quantiles(df, columns, [0.0, 0.25, 0.75, 1.0], cfg, ends)
    quartiles = {n: q[1:3] for n, q in found.items() if q and q[2] > q[1]}
    schema = ("column string, q1 double, q3 double, lower double, upper double, min_num double, max_num double, "
              "n_outside bigint")
    if not quartiles:
        return df.sparkSession.createDataFrame([], schema)
    edges = fences(quartiles, cfg.extreme_iqr)
    values = df.selectExpr(*[f"CAST({columns[n]} AS DOUBLE) AS v{i}" for i, n in enumerate(edges)])
    beyond = {i: e for i, (n, e) in enumerate(edges.items()) if found[n][0] < e[0] or found[n][3] > e[1]}  # the extremes tell
    seen = values.agg(*[F.count_if((F.col(f"v{i}") < lo) | (F.col(f"v{i}") > hi)).alias(f"e{i}")
                        for i, (lo, hi) in beyond.items()]).first() if beyond else {}
    rows = [(n, *quartiles[n], lo, hi, found[n][0], found[n][3], seen[f"e{i}"] if i in beyond else 0)
            for i, (n, (lo, hi)) in enumerate(edges.items())]
    return df.sparkSession.createDataFrame(rows, schema)


def _outlier_findings(outside: DataFrame, decided: DataFrame, cfg: LensConfig) -> DataFrame:
    detail = F.format_string(
        f"%d value(s) outside IQR×{cfg.extreme_iqr} (expected [%.2f, %.2f], actual [%.2f, %.2f]). "
        "Outliers kept. Charts will mark them.", "n_outside", "lower", "upper", "min_num", "max_num")
    return (outside.where("n_outside > 0").join(F.broadcast(decided.select("column", "ord")), "column")
            .select(F.lit(2).alias("rank"), "ord", F.lit(99).alias("step"), "column", F.lit("outliers").alias("rule"),
                    detail.alias("detail"), F.col("n_outside").alias("n")))


def _row_findings(groups: DataFrame) -> DataFrame:
    detail = F.concat(F.col("duplicate_groups").cast("string"),
                      F.lit(" row group(s) appear more than once. "
                            "Rows kept — removing may affect aggregate counts."))
    return groups.where("duplicate_groups > 0").select(
        F.lit(3).alias("rank"), F.lit(0).alias("ord"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("column"),
        F.lit("duplicate_rows").alias("rule"), detail.alias("detail"), F.col("duplicate_groups").alias("n"))


def assemble_report(findings: DataFrame) -> DataFrame:
    """Order the findings and attach severity and issue text."""
    issue = F.create_map(*[F.lit(v) for rule, (sev, text) in fv.ISSUES.items() for v in (rule, text)])
    severity = F.create_map(*[F.lit(v) for rule, (sev, text) in fv.ISSUES.items() for v in (rule, sev)])
    rows = findings.select("*", severity[F.col("rule")].alias("severity"), issue[F.col("rule")].alias("issue"))
    # findings number at most a few per column, so one array holds them; posexplode numbers them
    ordered = rows.agg(F.array_sort(F.collect_list(
        F.struct("rank", "ord", "step", "severity", "column", "rule", "issue", "detail", "n"))).alias("f"))
    return ordered.select(F.posexplode("f").alias("pos", "r")).select(
        F.col("pos").alias("ord"), "r.severity",
        # a dropped duplicate column is reported without a column key
        F.when(F.col("r.rule") != "duplicate_column", F.col("r.column")).alias("column"),
        "r.rule", "r.issue", "r.detail", "r.n")


def screen(df: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """The decisions on a table's columns, kept as a small local table.

    Whether a text column has a single value is first told by hashes, in the scan that counts texts. Extremes of texts, which cost far more, are
    then taken only of the columns for which a hash says so, to be certain, and of amounts, which show an example; others have none.
    """
    repeated = repeated_names(df.columns)
    stats = pin_small(column_stats(df, cfg, quartiles=False, sketches=False, ends=False))
    asked = [r["ord"] for r in decide(stats, repeated, cfg).collect()
             if r["kind"] == "string" and (r["single_value"] or r["action"] == "currency")]
    if asked:
        ends = pin_small(text_ends(df, {i: df.schema[i] for i in asked}))
        names = ("single_value", "min_text", "max_text")
        seen = ends.select("ord", *[F.col(n).alias(f"_{n}") for n in names])
        stats = stats.join(F.broadcast(seen), "ord", "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*[f"_{n}" for n in names])
    return pin_small(decide(stats, repeated, cfg))


def _with_examples(df: DataFrame, decided: DataFrame) -> DataFrame:
    """min_text of amount columns becomes the smallest text that casts and is no sentinel word; often the smallest of all is one."""
    fits = f"coalesce({tx.casts_as_currency('min_text')} AND NOT {tx.is_sentinel('min_text')}, false)"
    amounts = [r["column"] for r in decided.where("action = 'currency'").where(f"NOT ({fits})").orderBy("ord").collect()]
    if not amounts:
        return decided
    seen = df.agg(*[F.expr(f"min(CASE WHEN {tx.casts_as_currency(tx.ident(c))} AND NOT {tx.is_sentinel(tx.ident(c))} "
                           f"THEN {tx.ident(c)} END) AS e{i}") for i, c in enumerate(amounts)]).first()
    known = F.create_map(*[F.lit(x) for i, c in enumerate(amounts) for x in (c, seen[i])])
    return decided.withColumn("min_text", F.coalesce(known[F.col("column")], F.col("min_text")))


def clean(df: DataFrame, cfg: LensConfig = DEFAULT, check_rows: bool = True) -> Cleaned:
    """Screen and clean a table. One wide scan for the statistics, then one each for fences and duplicate rows."""
    df = without_nan(df)
    decided = screen(df, cfg)
    rows = decided.orderBy("ord").collect()
    table = project(df, rows)
    kept = set(table.columns)
    numeric = {r["column"]: _cleaned_column(r) for r in rows if r["column"] in kept
               and (r["kind"] in NUMERIC_KINDS or r["action"] == "number")}
    findings = column_findings(_with_examples(df, decided), cfg)
    if numeric:
        ends = {r["column"]: (r["min_num"], r["max_num"]) for r in rows if r["column"] in numeric and r["kind"] in NUMERIC_KINDS
                and r["min_num"] is not None}
        findings = findings.unionByName(_outlier_findings(extreme_outliers(df, numeric, cfg, ends), decided, cfg))
    if check_rows:
        findings = findings.unionByName(_row_findings(row_groups(df.select(*[tx.col(c) for c in table.columns]), cfg)))
    report = pin_small(assemble_report(findings))
    return Cleaned(table, report, decided.withColumn("kept", F.col("column").isin(*kept)))


def has_issues(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or(F.col("severity").isin("warn", "drop")), F.lit(False)).alias("has_issues"))


def context_text(report: DataFrame) -> DataFrame:
    """One row of text listing warnings and drops, in report order."""
    label = F.create_map(*[F.lit(v) for kv in fv.SEVERITY_LABELS.items() for v in kv])[F.col("severity")]
    line = F.concat(F.lit("- "), label, F.lit(" "),
                    F.coalesce(F.concat("column", F.lit(": ")), F.lit("")), "issue", F.lit(". "), "detail")
    lines = F.transform(F.array_sort(F.collect_list(F.when(label.isNotNull(), F.struct("ord", line.alias("line"))))),
                        lambda s: s["line"])
    return report.agg(lines.alias("lines")).select(
        F.when(F.size("lines") > 0, F.concat_ws("\n", F.lit(fv.CONTEXT_HEADER), F.col("lines")))
        .otherwise(F.lit(fv.NO_ISSUES_CONTEXT)).alias("context"))
