"""Cleaning rules on small frames."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tablelens import clean
from tablelens.config import LensConfig
from tablelens.operators import cleaning as cl
from tablelens.plans import report as rp


def rules(cleaned):
    return {(r["column"], r["rule"]) for r in cleaned.report.collect()}


def values(cleaned, column):
    return [r[0] for r in cleaned.table.select(f"`{column}`").collect()]


def frame(spark, name, items, kind="string"):
    return spark.createDataFrame([(v, i) for i, v in enumerate(items)], f"`{name}` {kind}, row_no int")


def test_booleans_and_nested_columns_pass_through(spark):
    df = spark.createDataFrame([(True, ["a"], {"k": 1}, 1), (False, ["b"], {"k": 2}, 2), (True, None, {"k": 1}, 3)],
                               "active boolean, tags array<string>, m map<string,int>, n int")
    out = clean(df)
    assert out.table.schema == df.schema
    assert out.table.count() == 3


def test_padding_is_trimmed(spark):
    assert sorted(values(clean(frame(spark, "name", ["  ann ", "bob", " cy"])), "name")) == ["ann", "bob", "cy"]


def test_currency_needs_95_percent_and_sentinels_count_against_it(spark):
    many = ["N/A"] * 2 + ["$1,200.50"] * 18
    kept = clean(frame(spark, "price", many))
    assert dict(kept.table.dtypes)["price"] == "string"
    assert ("price", "currency") not in rules(kept) and ("price", "sentinel") in rules(kept)
    cast = clean(frame(spark, "price", many), LensConfig(exclude_sentinels=True))
    assert dict(cast.table.dtypes)["price"] == "double"
    assert set(values(cast, "price")) == {None, 1200.5}


def test_thousands_separators_are_removed_in_the_cast(spark):
    out = clean(frame(spark, "delta", ["-1,000", "-2.5", "3e2", "-7"]))
    assert sorted(values(out, "delta")) == [-1000.0, -7.0, -2.5, 300.0]


def test_flag_patterns_agree_with_the_casts(spark):
    texts = ["$1,2.5", "€ 3", ",", "1,000", "- 5", "-,5", "1e5", "1e", ".5", ".", "1d", "1_000", "", " ", "5 €", "1.2.3", "+7",
             " 8 ", "$", "20230105", "-1,0 0", "1 000", "NaN", "٣"]
    df = frame(spark, "t", texts)
    from tablelens.functions import text as tx
    row = df.selectExpr(
        f"count_if(({tx.casts_as_currency('t')}) <> ({tx.parse_currency('t')} IS NOT NULL)) AS a",
        f"count_if(({tx.casts_as_number('t')}) <> ({tx.parse_grouped_number('t')} IS NOT NULL)) AS b",
        f"count_if(({tx.casts_as_currency('t')} OR {tx.looks_like_currency('t')}) AND NOT ({tx.may_be_number_or_date('t')})) AS c",
        f"count_if({tx.casts_as_number('t')} AND NOT ({tx.casts_as_currency('t')})) AS d").first()
    assert tuple(row) == (0, 0, 0, 0)


def test_numeric_text_is_checked_for_outliers(spark):
    out = clean(frame(spark, "v", [f"-{i}.5" for i in range(1, 40)] + ["-99999"]))
    assert ("v", "outliers") in rules(out)


def test_mixed_text_is_kept(spark):
    out = clean(frame(spark, "m", ["-1", "-2", "-3", "x", "y"]))
    assert ("m", "mixed") in rules(out) and "x" in values(out, "m")
    detail = [r["detail"] for r in out.report.collect() if r["rule"] == "mixed"][0]
    assert detail.startswith("60% of values look numeric, 40% are text.")


def test_dates_use_the_winning_format(spark):
    us = clean(frame(spark, "d", ["05/20/2023", "1/2/2023", "12/31/2022"]))
    assert sorted(values(us, "d")) == [datetime(2022, 12, 31), datetime(2023, 1, 2), datetime(2023, 5, 20)]
    iso = clean(frame(spark, "d", ["2023-01-05", "2023-01-05 10:30:00", "2023-01-06T01:02:03.5"]))
    assert datetime(2023, 1, 5, 10, 30) in values(iso, "d")
    two = clean(frame(spark, "d", ["2023-01-05", "2023-01-06", "20/05/2023", "21/05/2023"]))
    assert ("d", "mixed_dates") in rules(two) and "20/05/2023" in values(two, "d")
    some = clean(frame(spark, "d", ["2023-01-05", "2023-01-06", "2023-01-07", "soon"]))
    assert ("d", "mixed_dates") in rules(some)


def test_partial_dates_and_times_are_not_dates(spark):
    for text in ("12:30", "2023-13-05", "2023"):
        out = clean(frame(spark, "d", [text, text + "x", "z"]))
        assert dict(out.table.dtypes)["d"] == "string"


def test_screening_and_row_count(spark):
    df = spark.createDataFrame([(1, 1, None, "x", None), (2, 2, None, "x", "y"), (3, 3, None, "x", "y")],
                               "`a` int, `a.1` int, none string, same string, same_or_null string")
    out = clean(df)
    assert out.table.columns == ["a"] and out.table.count() == 3
    assert {r for _, r in rules(out)} == {"duplicate_column", "all_null", "constant"}
    assert [r["column"] for r in out.report.collect() if r["rule"] == "duplicate_column"] == [None]


def test_repeated_names():
    assert cl.repeated_names(["a", "a.1", "b.2", "b", "c"]) == {"a.1": "a", "b": "b"}


def test_empty_and_single_row_tables_keep_their_columns(spark):
    empty = clean(spark.createDataFrame([], "a int, b string, c double"))
    assert empty.table.columns == ["a", "b", "c"] and empty.report.count() == 0
    one = clean(spark.createDataFrame([(1, "x")], "a int, b string"))
    assert one.table.columns == ["a", "b"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 2), (2.0, 3), (None, 4)], "x double, n int")
    decided = {r["column"]: r for r in clean(df).decisions.collect()}
    assert decided["x"]["nulls"] == 2 and decided["x"]["max_num"] == 2.0


def test_odd_names_and_decimals(spark):
    df = spark.createDataFrame([(" a ", Decimal("1.50"), 1), ("b", Decimal("2.50"), 2)],
                               "`my `` odd.name x` string, `d e` decimal(10,2), n int")
    out = clean(df)
    assert out.table.columns == ["my ` odd.name x", "d e", "n"]
    assert sorted(r[0] for r in out.table.collect()) == ["a", "b"]


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "1", "x"), (2, "b", "y"), (2, "b", "y"), (2, "b", "y")],
                               "a int, b string, c string")
    weak = lambda _: [F.lit(1).cast("bigint"), F.length("c").cast("bigint")]
    for marks in (cl.row_marks, weak):  # content decides, also where fingerprints of different rows are equal
        for cfg in (LensConfig(), LensConfig(broadcast_rows=0)):
            row = cl.row_groups(df, cfg, marks).first()
            assert (row.rows, row.distinct_rows, row.duplicate_rows, row.duplicate_groups) == (6, 3, 3, 2)
    assert tuple(cl.row_groups(df.limit(0)).first()) == (0, 0, 0, 0)


def test_null_positions_distinguish_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert cl.row_groups(df).first().distinct_rows == 2


def test_maps_are_compared_by_content(spark):
    df = spark.createDataFrame([({"k": 1},), ({"k": 1},), ({"k": 2},)], "m map<string,int>")
    assert cl.row_groups(df).first().duplicate_groups == 1


def test_report_texts(spark):
    df = spark.createDataFrame(
        [(i, 10.0 + i % 7 if i else 99999.0, "N/A" if i % 10 == 0 else f"w{i}", None, "NYC") for i in range(100)],
        "id int, score double, note string, empty string, constant string")
    out = clean(df)
    found = {r["rule"]: r for r in out.report.collect()}
    assert found["outliers"]["detail"].startswith("1 value(s) outside IQR×3.0 (expected [")
    assert "actual [10.00, 99999.00]" in found["outliers"]["detail"]
    text = rp.bundle(out.report).first()
    assert text.has_changes
    assert text.plain_text.startswith("While preparing your data, the following changes were made:\n\n  - Column")
    assert 'Column "note": 10 values like "N/A" or "unknown" treated as empty.' in text.sentences
    assert [r.bucket for r in rp.buckets(out.report).collect()] == sorted(r.bucket for r in rp.buckets(out.report).collect())
    context = cl.context_text(out.report).first().context
    assert "- DROPPED empty: all-null column removed. 100% of values are NULL." in context and "sentinel" not in context
    assert cl.has_issues(out.report).first()[0] is True


def test_clean_table_has_nothing_to_say(spark):
    out = clean(spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ef")], "n int, s string"))
    assert rp.bundle(out.report).first().plain_text == "Your data looks clean. No changes were needed."
    assert cl.context_text(out.report).first().context == "Data quality: no issues found. All columns are clean."
    assert cl.has_issues(out.report).first()[0] is False


def test_high_missing_counts_text_only(spark):
    df = spark.createDataFrame([("a" if i % 2 else None, float(i) if i % 2 else None, f"w{i}") for i in range(9)],
                               "t string, x double, w string")
    df = df.replace("a", "b", "t").unionByName(df.where("t = 'a'").limit(1))
    assert {c for c, r in rules(clean(df)) if r == "high_missing"} == {"t"}
