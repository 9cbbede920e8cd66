"""Profiles, roles, chart data and the catalogue."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens import chart_catalogue, chart_frame, profile
from tablelens.config import LensConfig
from tablelens.functions.stats import two_sided_p
from tablelens.operators import chart_data as cd
from tablelens.operators import profiling as pf
from tablelens.operators.column_stats import column_stats, pinned_stats
from tablelens.plans import catalogue as ct


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame([(["Oslo", "Rome", "Kyiv", "Bonn"][i % 4], i % 2 == 0, 100 + 7 * i) for i in range(40)],
                                 "city string, is_active boolean, revenue int")


def test_booleans_are_categories(spark, cities):
    roles = {r["column"]: r["role"] for r in ct.column_roles(pinned_stats(cities)).collect()}
    assert roles == {"city": "categorical", "is_active": "categorical", "revenue": "identifier"}


def test_catalogue_is_a_prefix_of_the_pool(spark, cities):
    df = cities.withColumn("amount", F.col("revenue") * 1.5).withColumn("other", F.col("revenue") * 3.0 + 1)
    stats = pinned_stats(df)
    pool = [tuple(r) for r in chart_catalogue(df, stats, None).collect()]
    for n in (3, 6, 100):
        assert [tuple(r) for r in chart_catalogue(df, stats, n).collect()] == [p for p in pool if p[0] < 9][:n]
    assert "R05" in {p[2] for p in pool}
    for row in chart_catalogue(df, stats, None).collect():
        assert chart_frame(df, row, stats).count() > 0


def test_identifier_names(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1)], "id int, user_id int, UUID_x int, Row_num int, idle int")
    found = {r[0] for r in pinned_stats(df).where(ct.identifier_test(LensConfig(chart_identifier_ratio=2.0))).select("column").collect()}
    assert found == {"id", "user_id", "UUID_x", "Row_num"}


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(101)] + [(None,)], "x double")
    rows = cd.histogram(df, "x").orderBy("bin").collect()
    assert len(rows) == 30 and sum(r.n for r in rows) == 101 and rows[-1].n > 0
    flat = cd.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()
    assert [(r.bin, r.n) for r in flat] == [(0, 2)]
    assert cd.histogram(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_correlation_of_flat_and_short_columns(spark):
    df = spark.createDataFrame([(float(i), 0.1, float(-2 * i), None if i < 15 else float(i)) for i in range(20)],
                               "a double, flat double, b double, few double")
    rows = {(r.x, r.y): r for r in cd.correlations(df, [("a", "flat"), ("a", "b"), ("a", "few")]).collect()}
    assert rows["a", "flat"].r is None
    assert rows["a", "b"].r == pytest.approx(-1.0)
    assert rows["a", "few"].n == 5
    assert [(r.x, r.y) for r in cd.strong_pairs(df, ["a", "flat", "b", "few"]).collect()] == [("a", "b")]


def test_listwise_and_pairwise_matrices(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), None if i % 2 else float(i * i), "t") for i in range(30)],
                               "a double, b double, c double, t string")
    pdf = df.toPandas()[["a", "b", "c"]]
    for listwise, want in ((True, pdf.dropna().corr()), (False, pdf.corr())):
        for r in cd.heatmap(df, ["a", "b", "c"], listwise=listwise).collect():
            assert r.r == pytest.approx(want.loc[r.x, r.y], abs=1e-9)
            assert (r.shown is not None) == (abs(want.loc[r.x, r.y]) >= 0.5)
    assert cd.heatmap(df, ["a", "b"]).count() == 0
    assert cd.heatmap(df.limit(4), ["a", "b", "c"]).count() == 0


def test_p_values():
    # two-sided p of Student's t, from published tables
    t = np.array([12.706, 2.228, 1.96, 0.0, 3.291])
    df = np.array([1.0, 10.0, 1e7, 5.0, 1e7])
    assert two_sided_p(t, df) == pytest.approx([0.05, 0.05, 0.05, 1.0, 0.001], abs=2e-5)


def test_significance(spark):
    pairs = spark.createDataFrame([(0, "a", "b", 12, 0.576), (1, "a", "c", 2, 1.0)], cd.PAIR_SCHEMA)
    rows = cd.with_significance(pairs).orderBy("ord").collect()
    assert rows[0].p == pytest.approx(0.05, abs=1e-3) and rows[1].p is None


def test_periods(spark):
    assert [cd.period_for(n) for n in (None, 0, 60, 61, 730, 731)] == ["day", "day", "day", "week", "week", "month"]


def test_weeks_start_on_monday(spark):
    df = spark.sql("SELECT timestamp_ntz'2023-01-01' + make_dt_interval(id) AS ts FROM range(100) t(id)")
    first = cd.records_over_time(df, "ts").first()
    assert (str(first.period), first.n) == ("2022-12-26 00:00:00", 1)


def test_median_is_used_when_there_are_outliers(spark):
    df = spark.createDataFrame([("a", float(i % 5)) for i in range(20)] + [("a", 1e6), ("b", 2.0)], "k string, v double")
    stats = pinned_stats(df)
    row = {"rule": "R04", "x": "k", "y": "v"}
    assert {r.category: r.result for r in chart_frame(df, row, stats).collect()} == {"a": 2.0, "b": 2.0}


def test_semantic_types(spark):
    df = spark.createDataFrame(
        [(i, float(i), "yes" if i % 2 else " No ", "2023-01-%02d" % (i % 28 + 1), f"u{i}", "x" * 60 + str(i % 9), None, i % 3, "ab")
         for i in range(200)],
        "key_no int, x double, flag string, day string, code string, memo string, none string, group_no int, kind string")
    found = {r[0]: r[1] for r in pinned_stats(df).select("column", pf.semantic_type()).collect()}
    assert found == {"key_no": "identifier", "x": "numeric", "flag": "boolean", "day": "datetime", "code": "identifier",
                     "memo": "text", "none": "categorical", "group_no": "numeric", "kind": "categorical"}


def test_profile_of_a_table(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 0 else float(i), "a b", "v%d" % (i % 40)) for i in range(60)],
                               "n int, x double, `my col` string, w string")
    columns, summary, warnings = profile(df, distinct="exact")
    rows = {r["column"]: r for r in columns.collect()}
    assert rows["x"].missing_count == 1 and rows["x"].numeric_summary["median"] == 30.0
    assert rows["x"].numeric_summary["skewness"] == 0.0
    assert len(rows["w"]["values"]) == 5 and rows["my col"]["values"] == ["a b"]
    assert summary.first().duplicate_row_count == 0
    assert {(r["column"], r["type"]) for r in warnings.collect()} == {("my col", "constant"), ("w", "high_cardinality")}
    docs = [r[1] for r in pf.profile_documents(columns).orderBy("ord").collect()]
    assert '"sql_reference":"\\"my col\\""' in docs[2] and "sql_reference" not in docs[0]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 2000).cast("string").alias("v"), F.col("id").alias("w"))
    stats = pinned_stats(df, distinct="exact", exact_quartiles=False)
    a, b = ({r["column"]: r["values"] for r in pf.sample_values(d, stats).collect()} for d in (df, df.repartition(7)))
    assert a == b and all(len(v) == 5 for v in a.values())
    # the hash range kept first holds the lowest hashes of all values
    lowest = df.select("v").distinct().orderBy(F.xxhash64("v")).limit(5)
    assert a["v"] == [r.v for r in lowest.collect()]


def test_wide_tables(spark):
    df = spark.range(50).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(1, 121)])
    stats = column_stats(df).orderBy("ord").collect()
    assert [s["column"] for s in stats] == df.columns
    assert [s["max_num"] for s in stats] == [49.0 * k for k in range(1, 121)]
    assert all(s["approx_distinct"] == 50 for s in stats)


def test_short_columns(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, k int")
    rows = {s["column"]: s for s in column_stats(df).collect()}
    assert rows["x"]["skewness"] is None and rows["k"]["single_value"] and math.isclose(rows["x"]["std"], math.sqrt(0.5))
