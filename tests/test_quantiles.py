from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import quantiles as Q
from pulsegrid.operators.quantiles import attach, exact_mode, exact_quantiles, value_range

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}


def frame(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "k string, v double")


def check(spark, groups, few):
    found = {r["k"]: r for r in exact_quantiles(frame(spark, groups), ["k"], "v", PROBS, few).collect()}
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        if not known:
            assert key not in found
            continue
        for name, p in PROBS.items():
            assert found[key][name] == pytest.approx(np.percentile(known, 100 * p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("few", [True, False])
def test_against_numpy(spark, few):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(0, 100, 997).tolist(),
        "ties": [1.0] * 50 + [2.0] * 3 + [-1.0],
        "single": [4.25],
        "two": [1.0, 2.0],
        "zeros": [0.0, -0.0, 0.0, 5.0],
        "tiny": [1e-300, -1e-300, 1e300, -1e300, 0.0],
        "missing": [None, None],
        "some": [None, 3.0, None, 1.0],
        None: [7.0, 8.0, 9.0],
    }
    check(spark, groups, few)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, {"g": values}, True)


def test_nan_counts_as_missing(spark):
    row = exact_quantiles(frame(spark, {"a": [float("nan"), 1.0, 3.0]}), ["k"], "v", {"m": 0.5}).first()
    assert row["m"] == 2.0


def test_without_keys(spark):
    df = frame(spark, {"a": [1.0, 2.0], "b": [10.0]})
    assert [r["m"] for r in exact_quantiles(df, [], "v", {"m": 0.5}).collect()] == [2.0]
    assert exact_quantiles(df.where("v > 100"), [], "v", {"m": 0.5}).count() == 0


def test_one_group_with_most_rows(spark):
    df = spark.range(30_000).select(F.lit("big").alias("k"), ((F.col("id") * 7919) % 30_011).cast("double").alias("v"))
    values = np.array([(i * 7919) % 30_011 for i in range(30_000)], float)
    row = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.999}, True).first()
    assert row["a"] == np.percentile(values, 25)
    assert row["b"] == pytest.approx(np.percentile(values, 99.9), rel=1e-14)


def test_value_range_is_monotone(spark):
    values = sorted([0.0, 1e-9, -1e-9, 1.0, 1.0000001, 2.0, -5.5, 1e12, -1e12, float("inf"), 0.3, 0.30001])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranges = [r[0] for r in df.orderBy("v").select(value_range("v")).collect()]
    assert ranges == sorted(ranges)


def test_mode_takes_the_smallest_on_a_tie(spark):
    groups = {"tie": [3.0, 1.0, 3.0, 1.0, 2.0], "clear": [5.0, 5.0, 1.0], "missing": [None]}
    found = {r["k"]: r["m"] for r in exact_mode(frame(spark, groups), ["k"], "v", "m").collect()}
    assert found == {"tie": 1.0, "clear": 5.0}


def test_attach_matches_missing_keys(spark):
    left = spark.createDataFrame([("a",), (None,), ("z",)], "k string")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    assert {r["k"]: r["x"] for r in attach(left, right, ["k"]).collect()} == {"a": 1, None: 2, "z": None}


def test_weighted_quantiles_count_rows(spark):
    rows = [(i % 3, float((i * 7) % 11), 1 + i % 4) for i in range(60)] + [(3, None, 5)]
    counted = spark.createDataFrame(rows, "k int, v double, n long")
    plain = counted.selectExpr("k", "v", "explode(sequence(1, int(n)))").select("k", "v")
    wanted = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    for few in (True, False):
        take = lambda df, **o: sorted(map(tuple, Q.exact_quantiles(df, ["k"], "v", wanted, few_groups=few, **o).collect()))  # noqa: B023,E731
        assert take(counted, weight="n") == take(plain)


def test_sketches_keep_their_bound_and_merge(spark):
    from pulsegrid.operators import sketches as K

    df = spark.range(40_000).selectExpr("id % 4 AS g", "cast(pow(id, 1.3) AS double) AS v").repartition(6)
    df = df.unionByName(spark.createDataFrame([(0, None), (1, float("nan"))], "g long, v double"))
    parts = K.quantile_sketches(df, ["g"], "v", size=200)
    assert {r["n"] for r in parts.collect()} == {10_000}
    whole = K.sketch_quantiles(K.merge_sketches(parts, [], size=200), {"a": 0.1, "b": 0.5, "c": 0.99}, []).first()
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        assert abs(df.where(f"v <= {whole[name]!r}D AND NOT isnan(v)").count() / 40_000 - p) <= K.rank_error(200)
    assert whole["n"] == 40_000 and K.rank_error(800) < 0.006
