"""Plain-language view of a quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens import fixed_values as fv


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(\d+)\b", 1)


def first_percent(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+%)", 1)


def sentence(severity: Column, column: Column, issue: Column, detail: Column) -> Column:
    """The sentence for a report row; null when no template applies."""
    lead = F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit('Column "'), column, F.lit('": '))).otherwise("")
    text = F.coalesce(detail, F.lit(""))
    figures = {"{number}": first_number(text), "{percent}": first_percent(text)}
    out = F.lit(None).cast("string")
    for sev, fragment, with_figure, without, rest in reversed(fv.SENTENCES):
        subject = F.lit("")
        if with_figure:
            mark, tail = with_figure[:with_figure.index("}") + 1], with_figure[with_figure.index("}") + 1:]
            subject = F.when(figures[mark] != "", F.concat(figures[mark], F.lit(tail))).otherwise(F.lit(without))
        # a finding about whole rows names no column
        start = F.lit("") if fragment == "duplicate rows" else lead
        out = F.when((severity == sev) & issue.contains(fragment), F.concat(start, subject, F.lit(rest))).otherwise(out)
    return out


def sentences(report: DataFrame) -> DataFrame:
    """ord, severity, sentence for every row that has one."""
    s = sentence(F.col("severity"), F.col("column"), F.col("issue"), F.col("detail"))
    return report.select("ord", "severity", s.alias("sentence")).where("sentence IS NOT NULL")


def bundle(report: DataFrame) -> DataFrame:
    """One row: has_changes, sentences, plain_text."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda s: s["sentence"])
    listed = sentences(report).agg(in_order.alias("sentences"))
    lines = F.transform("sentences", lambda s: F.concat(F.lit("  - "), s))
    return listed.select(
        (F.size("sentences") > 0).alias("has_changes"), "sentences",
        F.when(F.size("sentences") > 0, F.concat_ws("\n", F.lit(fv.CHANGES_HEADER), lines))
        .otherwise(F.lit(fv.NO_CHANGES_TEXT)).alias("plain_text"))


def buckets(report: DataFrame) -> DataFrame:
    """Sentences grouped as Removed, Note, Fixed: bucket, ord, text (in that order)."""
    place = F.create_map(*[F.lit(v) for i, (sev, _) in enumerate(fv.BUCKETS) for v in (sev, i)])[F.col("severity")]
    word = F.create_map(*[F.lit(v) for pair in fv.BUCKETS for v in pair])[F.col("severity")]
    return sentences(report).select(
        place.alias("bucket"), "ord", F.concat(word, F.lit("  —  "), "sentence").alias("text")
    ).orderBy("bucket", "ord")
