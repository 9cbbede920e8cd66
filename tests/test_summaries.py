"""Mergeable summaries: frequent values, smallest values, Gram matrices, density grids and stored profiles."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.config import LensConfig
from tablelens.operators import chart_data as cd
from tablelens.operators import stored_profile as sp
from tablelens.operators import summaries

FEW = LensConfig(frequent_counters=16)


def top(values, n=10):
    return [(v, k) for v, k in sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))[:n]]


def skewed(rng, n, distinct):
    return [f"v{int(distinct * rng.random() ** 6)}" for _ in range(n)]


@pytest.mark.parametrize("kind", ["few", "skewed", "unique", "ties", "level", "nulls", "empty"])
def test_most_frequent_values(spark, kind):
    rng = random.Random(3)
    values = {
        "few": [rng.choice("abc") for _ in range(500)], "skewed": skewed(rng, 6000, 900), "unique": [f"u{i * 7919 % 5000}" for i in range(5000)],
        # thirteen values tie from rank two on, and the others are rare
        "ties": ["x"] * 50 + [v for k in range(13) for v in [f"t{k:02}"] * 20] + [f"r{i}" for i in range(900)],
        # hundreds of values occur twice, more once
        "level": [f"p{i % 300:03}" for i in range(600)] + [f"q{i}" for i in range(900)] + ["z"] * 5,
        "nulls": [None] * 300 + ["é", "", "e"], "empty": [],
    }[kind]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = [(r.value, r.n) for r in summaries.most_frequent(df, [F.col("v")], FEW).orderBy("rank").collect()]
    assert got == top(values)


def test_counters_bound_what_they_miss():
    rng = random.Random(1)
    values, counters = skewed(rng, 20_000, 5000), summaries.Frequent(32)
    for low in range(0, len(values), 700):
        counters.add(pa.array(values[low:low + 700]))
    kept = dict(zip(*counters.merge().to_pydict().values()))
    assert len(kept) <= 32 and 0 < counters.error <= 20_000 / 33
    for v, n in Counter(values).items():
        assert kept.get(v, 0) <= n <= kept.get(v, 0) + counters.error


def test_smallest_hashes(spark):
    rows = [(f"v{i % 700}", i % 3) for i in range(3000)] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "v string, k int").repartition(4)
    got = summaries.smallest_hashes(df, [F.col("v"), F.col("k")], 5).orderBy("ord", "place").collect()
    want = [r.v for r in df.where("v IS NOT NULL").select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(5).collect()]
    assert [r.value for r in got if r.ord == 0] == want and {r.value for r in got if r.ord == 1} == {"0", "1", "2"}


@pytest.mark.parametrize("cfg", [LensConfig(), LensConfig(gram_columns=7, gram_bytes=1 << 13)])
def test_gram_correlations_match_pairwise_ones(spark, cfg):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)) * 10.0 ** rng.integers(-3, 6, 24) + 1e3
    x[:, 3] = 2 * x[:, 1] + rng.normal(size=400)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:390, 8] = 5.0, np.nan
    names = [f"c {i}" for i in range(24)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{c}` double" for c in names)).repartition(3)
    pairs = [p if k % 3 else p[::-1] for k, p in enumerate(combinations(names, 2))]
    for r in cd.correlations(df, pairs, cfg).collect():
        a, b = x[:, names.index(r.x)], x[:, names.index(r.y)]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r.n == both.sum()
        if "c 7" in (r.x, r.y):
            assert r.r is None
        elif both.sum() > 2:
            assert r.r == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-7)


def test_wide_tables_take_two_scans():
    """300 numeric columns, all 44,850 pairs: the matrices of one scan hold them."""
    assert len(cd._tiles(300, set(combinations(range(300), 2)), LensConfig())) == 1
    tiles = cd._tiles(2000, set(combinations(range(2000), 2)), LensConfig())
    assert sum(map(len, tiles)) == 28 and len(tiles) == 2


def test_density_of_any_size(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(5000)] + [(50.0, 50.0)] * 2 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    out = cd.density(df, "x", "y", LensConfig(density_cells=20)).collect()
    assert len(out) <= 400 + 3 * 400 and sum(r.n for r in out) == 5002
    assert [(r.x, r.y, r.n) for r in out if r.kind == "point" and r.x > 40] == [(50.0, 50.0, 2)]
    flat = cd.density(spark.createDataFrame([(1.0, 2.0)] * 9, "x double, y double"), "x", "y").collect()
    assert [tuple(r) for r in flat] == [("cell", 1.0, 2.0, 1.0, 2.0, 9)]
    assert cd.density(df.limit(0), "x", "y").count() == 0


def test_a_merged_profile_is_the_profile_of_the_union(spark):
    rng = random.Random(2)
    rows = [(f"d{rng.randrange(7)}", rng.lognormvariate(0, 1) if rng.random() < .9 else None, rng.randrange(500), rng.choice(["a", "b", None]))
            for _ in range(4000)] + [("d9", None, None, None)] * 3
    df = spark.createDataFrame(rows, "day string, x double, k int, s string").repartition(4)
    parts = sp.stored_profile(df, "day")
    assert parts.count() == 8 * 4
    whole = {r.column: r for r in sp.profile_figures(sp.stored_profile(df)).collect()}
    by_half = sp.merged_profile(parts.withColumn("half", F.col("part") < "d3"), ["half"])
    twice = sp.merged_profile(by_half.drop("half"))  # merges of merges
    for merged in (sp.merged_profile(parts), twice):
        for r in sp.profile_figures(merged).collect():
            w = whole[r.column]
            assert (r.rows, r.nulls, r.min_num, r.max_num) == (w.rows, w.nulls, w.min_num, w.max_num) and r.type == w.type
            assert abs(r.n_distinct - w.n_distinct) <= 2 * sp.DISTINCT_ERROR * w.n_distinct + 1
            for name in ("mean", "std", "skewness"):
                assert (r[name] is None) == (w[name] is None) and (w[name] is None or math.isclose(r[name], w[name], rel_tol=1e-9, abs_tol=1e-9))
    xs = sorted(x for _, x, _, _ in rows if x is not None)
    median = next(r.median for r in sp.profile_figures(twice).collect() if r.column == "x")
    assert abs(sum(v <= median for v in xs) / len(xs) - 0.5) <= sp.RANK_ERROR + 1 / len(xs)
    assert sp.merged_profile(sp.stored_profile(df.limit(0))).count() == 0
