"""What a task holds or reads must not grow with the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.config import LensConfig
from tablelens.operators import quantiles as qu


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40_000, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        (F.pow(F.rand(5), 3) * 1e6 - 1e3).alias("v"), F.rand(6).alias("w"))


def test_columns_hand_on_a_fixed_number_of_places(rows):
    span = tuple(int(x) for x in qu.image(np.array([0.0, 1.0])))
    counted = qu._binned(rows.select(F.col("w").alias("v0")), {0: [span]}, qu.FINE_BITS).collect()
    assert len(counted) <= 2**qu.FINE_BITS and sum(r["n"] for r in counted) == 40_000
    assert all(span[0] <= r["lo"] <= r["hi"] <= span[1] for r in counted)


def test_images_have_an_inverse():
    values = [0.0, 5e-324, -5e-324, 1.5, -1.5, 1e308, -1e308, float("inf"), float("-inf")]
    assert [qu.from_image(int(x)) for x in qu.image(np.array(values))] == values


def test_medians_of_small_groups_are_sorted_not_counted(rows):
    plan = qu.grouped_median(rows, ["k"], "v")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("limit", [10, 1000, 1 << 20])
def test_small_and_large_groups_agree(rows, limit):
    pdf = rows.toPandas()
    want = {None if k != k or k is None else k: list(np.quantile(g, [0.0, 0.3, 0.5])) for k, g in pdf.groupby("k", dropna=False)["v"]}
    for sent in (0, 200_000):
        cfg = LensConfig(sorted_group_rows=limit, broadcast_rows=sent)
        found = {r["k"]: r["q"] for r in qu.selected(rows.select("k", "v"), ["k"], [0.0, 0.3, 0.5], cfg).collect()}
        assert found.keys() == want.keys()
        assert all(found[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_a_task_hands_on_what_hardly_combines(rows, monkeypatch):
    monkeypatch.setattr(qu, "HELD_ROWS", 64)
    pdf = rows.toPandas()
    found = {r["k"]: r["q"][0] for r in qu._by_radix(rows.select("k", "v"), ["k"], [0.5], LensConfig()).collect()}
    want = pdf.groupby("k", dropna=False)["v"].median()
    assert found == {None if k != k or k is None else k: pytest.approx(m, rel=1e-12) for k, m in want.items()}


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_response_is_parsed_once(spark):
    from tablelens.plans import specs as sp

    one = '{"title": "Rows", "chart_type": "bar"}'
    texts = [f'```json\n{{"charts": [{one}, {one}]}}\n```', '{"charts": []}', '{"charts": null}', '{"charts": [null]}', '{"other": 1}', "{", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    parsed = sp.parse_responses(df, "k", "t")
    assert _optimised(parsed).count("from_json") == 1
    assert [(r["k"], r["pos"], r["title"]) for r in parsed.orderBy("k", "pos").collect()] == [(0, 0, "Rows"), (0, 1, "Rows"), (3, 0, None)]
    assert "from_json" not in _optimised(sp.accept_responses(df, "k", "t"))  # both uses read what was parsed once


def test_statistics_without_sketches(spark):
    from tablelens.operators.cleaning import clean
    from tablelens.operators.column_stats import column_stats, pinned_stats

    df = spark.createDataFrame([(i % 7, float(i) if i % 3 else None, f"t{i % 9}", "same", None, i % 2 == 0) for i in range(100)],
                               "a int, b double, s string, c string, e string, f boolean")
    left_out = {"approx_distinct", "q1", "median", "q3"}
    with_, without = (column_stats(df, quartiles=k, sketches=k).orderBy("ord") for k in (True, False))
    assert "hll_sketch" not in _optimised(without) and "percentile" not in _optimised(without)
    plain = [{n: v for n, v in r.asDict().items() if n not in left_out} for r in without.collect()]
    assert plain == [{n: v for n, v in r.asDict().items() if n not in left_out} for r in with_.collect()]
    assert all(r[n] is None for r in without.collect() for n in left_out)
    kept = {r["column"]: r["kept"] for r in clean(df).decisions.collect()}
    assert kept == {"a": True, "b": True, "s": True, "c": False, "e": False, "f": True}
    assert [r["n_distinct"] for r in pinned_stats(df, exact_quartiles=None).orderBy("ord").collect()] == [7, 66, 9, 1, 0, 2]


def test_statistics_without_sketches_of_an_empty_table(spark):
    from tablelens.operators.column_stats import column_stats

    rows = column_stats(spark.createDataFrame([], "a int, s string"), quartiles=False, sketches=False).orderBy("ord").collect()
    assert [(r["rows"], r["nulls"], r["single_value"], r["min_text"]) for r in rows] == [(0, 0, False, None)] * 2


def test_distinct_values_unfold_in_generated_code(spark):
    from datetime import date, datetime

    from tablelens.operators.column_stats import distinct_counts

    rows = [(i % 5 - 2, float(i % 3) * (-1) ** i, bool(i % 2), date(2020, 1, 1 + i % 4), datetime(2020, 1, 1, i % 6), "t" + str(i % 8), [i % 2, None], None)
            for i in range(60)] + [(None, float("nan"), None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a bigint, b double, c boolean, d date, t timestamp_ntz, s string, l array<int>, z int")
    assert distinct_counts(df, df.columns) == {"a": 5, "b": 5, "c": 2, "d": 4, "t": 6, "s": 8, "l": 2, "z": 0}
