"""Exact quantiles by radix selection against a plain computation, whatever the distribution."""

import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.config import LensConfig
from tablelens.operators.quantiles import exact_quantiles, grouped_median, image, selected

UNSENT = LensConfig(broadcast_rows=0)
PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(60_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 5)).alias("key"),
        (F.pow(F.rand(5), 3) * 1e6).alias("skewed"),
        F.when(F.rand(7) < 0.6, F.lit(5.0)).otherwise(F.rand(8) * 10).alias("tied"),
        (F.col("id") % 11).alias("few"),
        F.when(F.col("id") % 2 == 0, F.rand(9)).alias("half"),
        (F.lit(1.0) + F.col("id") * F.lit(2.0 ** -52)).alias("close"),  # neighbouring doubles: all bits but the last are one bucket
        F.pow(F.lit(2.0), (F.col("id") % 2000) - 1000).alias("wide"),
        ((F.rand(3) - 0.5) * 1e-300).alias("tiny"),
        F.when(F.col("id") % 10 == 0, F.lit(float("inf"))).when(F.col("id") % 10 == 1, F.lit(float("-inf"))).when(
            F.col("id") % 10 == 2, F.lit(float("nan"))).otherwise(-F.rand(4)).alias("ends"),
    ).persist()


@pytest.mark.parametrize("cfg", [LensConfig(columns_per_pass=3), UNSENT])
def test_quantiles(numbers, cfg):
    columns = ["skewed", "tied", "few", "half", "close", "wide", "tiny", "ends"]
    found = exact_quantiles(numbers, {c: c for c in columns}, PROBS, cfg)
    pdf = numbers.toPandas()
    assert (found["ends"][0], found["ends"][-1]) == (float("-inf"), float("inf"))
    assert found["ends"][2] == pytest.approx(sorted(pdf["ends"].dropna())[(pdf["ends"].count() - 1) // 2], rel=1e-3)
    for c in columns[:-1]:
        assert found[c] == pytest.approx(list(np.quantile(pdf[c].dropna().astype(float), PROBS)), rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1.0, float("nan"))], "x double, y double, z double")
    assert exact_quantiles(df, {c: c for c in "xyz"}, [0.25, 0.5]) == {"x": None, "y": [1.0, 1.0], "z": None}


def _image(x):
    bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return bits if bits >= 0 else -(bits + 2**63)


def test_image_is_in_the_order_of_doubles():
    edge = [s * v for e in range(-1074, 1024) for v in (2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, np.inf)) for s in (1, -1)]
    values = sorted({float(v) for v in [*edge, 0.0, float("inf"), float("-inf"), 1.7976931348623157e308, 5e-324, 0.1, 1 / 3]})
    assert image(np.array(values)).tolist() == sorted(map(_image, values))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.floats(allow_nan=False, allow_infinity=False, width=64)), min_size=1, max_size=40))
def test_selection_of_any_doubles(spark, rows):
    found = selected(spark.createDataFrame(rows, "k string, v double"), ["k"], [0.0, 0.3, 1.0]).collect()
    for r in found:
        mine = sorted(v for k, v in rows if k == r.k)
        at = 0.3 * (len(mine) - 1)
        low, high = mine[int(np.floor(at))], mine[int(np.ceil(at))]
        assert r.n == len(mine) and (r.q[0], r.q[2]) == (mine[0], mine[-1]) and low <= r.q[1] <= high
    assert {r.k for r in found} == {k for k, _ in rows}


@pytest.mark.parametrize("cfg", [LensConfig(), UNSENT])
@pytest.mark.parametrize("column", ["skewed", "tied", "half"])
def test_grouped_median(numbers, cfg, column):
    rows = grouped_median(numbers, ["key"], column, "m", cfg).collect()
    want = numbers.toPandas().groupby("key", dropna=False)[column].median()
    want = {None if k != k or k is None else k: v for k, v in want.items()}
    assert {r["key"]: pytest.approx(r["m"], rel=1e-12) for r in rows} == want
