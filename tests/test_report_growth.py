"""The report takes few scans, its generated code is compiled, and what it keeps does not grow with the table."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions import text as tx
from tablelens.operators import cleaning as cl
from tablelens.operators import column_stats as cs
from tablelens.operators import quantiles as qu

ODD = ["$1,2.5", "€ 3", ",", "1,000", "- 5", "-,5", "1e5", ".5", ".", "1d", "1_000", "", " ", "5 €", "1.2.3", "+7", " 8 ", "$", "20230105", "-1,0 0", "1 000",
       "NaN", "٣", "-12", "+12.50", "$12", "¥3.25", "-", "--", "?", "0", "1", " 1", "7", "N/A", " n/a ", "na", "Yes", "F", "t ", "12\n", "-12\r\n", "$12\n",
       "12.", "$.5", "-$5", "$-5", " 20230105 ", "20231305", "20230229", "00000229", "1/2/2020", "13/2/2020", "2/13/2020", "31/04/2020", "29/2/1900",
       "29/02/2000\n", "1-2-2020", "2020/2/30", "2020/02/29", "2020-1-5", "2020-13-5", "2020-01-05 10:11", "2020-01-05T10:11:12.5", "2020-01-05T10:11:12Z",
       "03/15/1995 9:30", "15/03/1995 9:30", "03/15/1995 25:00", " 03/15/1995", "03/15/1995 ", "3/5/1995\n", "12/25", "1/2/20", "A", "NYC", "x" * 40, None]


def _flags(df):
    return df.selectExpr("t", f"{cs._look('t')} AS look").selectExpr("t", f"{cs._flag_word('t', 'look')} AS f")


def test_flags_say_what_the_patterns_and_casts_say(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    tests = {cs.SENTINEL: tx.is_sentinel("t"), cs.BOOLEAN: tx.is_boolean_word("t"), cs.CURRENCY: tx.looks_like_currency("t"),
             cs.CAST: tx.casts_as_currency("t"), cs.NUMBER: tx.casts_as_number("t")}
    tests |= {v: f"{tx.parse_date('t', f)} IS NOT NULL" for f, v in zip(cs.DATE_FORMAT_NAMES, cs.DATES)}
    want = " + ".join(f"CASE WHEN {test} THEN {v} ELSE 0 END" for v, test in tests.items())
    assert _flags(df).selectExpr("t", "f", f"CASE WHEN t IS NOT NULL THEN {want} END AS w").where("NOT (f <=> w)").collect() == []


def test_dates_that_exist(spark):
    days = [(y, m, d) for y in (0, 1900, 2000, 2023, 2024, 9999) for m in range(14) for d in range(33)]
    spelled = [f.format(y=y, m=m, d=d) for y, m, d in days for f in ("{d:02}/{m:02}/{y:04}", "{m}/{d}/{y:04}", "{d}-{m:02}-{y:04}", "{y:04}{m:02}{d:02}", "{y:04}/{m}/{d}")]
    df = spark.createDataFrame([(t,) for t in spelled], "t string")
    for f in tx.fv.EXISTING_DATES:
        assert df.where(f"({tx.is_date('t', f)}) <> ({tx.parse_date('t', f)} IS NOT NULL)").collect() == []
    real = sum(date(2024, 1, 1) + timedelta(i) < date(2025, 1, 1) for i in range(366))
    assert df.where(f"t LIKE '2024%' AND length(t) = 8 AND {tx.is_date('t', 'yyyyMMdd')}").count() == real


def test_flags_of_texts_run_as_compiled_code(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        columns = {i: f for i, f in enumerate(spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(12))).schema)}
        df = spark.range(5).select(*[F.col("id").cast("string").alias(f.name) for f in columns.values()])
        plan = cs._text_stats(df, columns, True, False, False)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 7_000  # the virtual machine interprets methods of more than 8,000 bytes


def test_screening_needs_no_extremes_of_other_texts(spark, monkeypatch):
    df = spark.createDataFrame([(f"${i}.50" if i else "-1", f"t{i % 9}", "same", None, i % 4, "N/A" if i == 7 else f"${i}") for i in range(40)],
                               "p string, s string, c string, e string, n int, q string")
    asked = []
    monkeypatch.setattr(cl, "text_ends", lambda df, columns: asked.append([f.name for f in columns.values()]) or cs.text_ends(df, columns))
    mine = {r["column"]: r for r in cl.screen(df).collect()}
    whole = {r["column"]: r for r in cl.decide(cs.column_stats(df, quartiles=False, sketches=False)).collect()}
    assert asked == [["p", "c", "q"]]
    for c, r in whole.items():
        assert {k: v for k, v in mine[c].asDict().items() if k not in ("min_text", "max_text")} == {
            k: v for k, v in r.asDict().items() if k not in ("min_text", "max_text")}
        assert mine[c]["min_text"] == (r["min_text"] if c in "pcq" else None)


def test_a_hash_alone_makes_no_column_constant(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    stats = cs.column_stats(df, quartiles=False, sketches=False, ends=False).withColumn("single_value", F.lit(True))  # as if hashes met
    monkeypatch.setattr(cl, "column_stats", lambda *a, **k: stats)
    assert cl.screen(df).first()["action"] == "trim"
