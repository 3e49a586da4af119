from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import errors as E, weights as W
from pulsegrid.operators import baselines, examples, leaderboard as L, metrics, profile
from pulsegrid.plans.profile import profile_tables, run_profile

SCHEMA = "model string, split string, y double, yhat double, ref_prev double"


def scored(spark, rows, model="m", split="val"):
    return spark.createDataFrame([(model, split, *r) for r in rows], SCHEMA)


def one(spark, rows, **measures):
    return scored(spark, rows).agg(*[c.alias(n) for n, c in measures.items()]).first()


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p, r = rng.gamma(1, 50, 500), rng.gamma(1, 50, 500), rng.gamma(1, 50, 500)
    row = metrics.evaluate(scored(spark, [tuple(map(float, t)) for t in zip(y, p, r)]), [50, 12.5]).first()
    e = np.abs(y - p)
    expected = {
        "MAE": e.mean(),
        "RMSE": np.sqrt((e**2).mean()),
        "MAPE": 100 * (e / np.maximum(np.abs(y), 1e-6)).mean(),
        "MAPE_safe": 100 * (e / np.maximum(np.abs(y), 10)).mean(),
        "R2": 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(),
        "WAPE": e.sum() / np.abs(y).sum(),
        "SMAPE": 200 * (e / (np.abs(y) + np.abs(p) + 1)).mean(),
        "ToleranceAcc@50": (e <= 50).mean(),
        "ToleranceAcc@12.5": (e <= 12.5).mean(),
        "DirectionalAcc": (np.sign(y - r) == np.sign(p - r)).mean(),
        **{f"P{q}_abs_err": np.percentile(e, q) for q in (50, 75, 90, 95)},
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, rel=1e-9), name
    assert (row["n_scored"], row["n_missing"]) == (500, 0)


def test_edges(spark):
    constant = one(spark, [(5.0, 4.0, None), (5.0, 7.0, None)], r2=E.r2(), dir=E.directional_accuracy(), mae=E.mae())
    assert (constant["r2"], constant["dir"], constant["mae"]) == (None, None, 1.5)
    zero = one(spark, [(0.0, 1.0, 0.0)], wape=E.wape(), mape=E.mape(), safe=E.mape_safe())
    assert zero["wape"] is None and zero["mape"] == pytest.approx(1e8) and zero["safe"] == pytest.approx(10)
    empty = one(spark, [], mae=E.mae(), n=E.pairs_scored())
    assert (empty["mae"], empty["n"]) == (None, 0)


def test_missing_forecasts_are_skipped_and_counted(spark):
    row = metrics.evaluate(scored(spark, [(1.0, 2.0, 0.0), (9.0, None, 0.0), (None, 4.0, 0.0), (5.0, 5.0, None)])).first()
    assert (row["MAE"], row["n_scored"], row["n_missing"], row["DirectionalAcc"]) == (0.5, 2, 2, 1.0)
    assert row["WAPE"] == pytest.approx(1 / 6) and row["R2"] == pytest.approx(1 - 1 / 8)


def test_identities(spark):
    rows = [(float(i % 7), float(i % 5), None) for i in range(40)]
    row = one(
        spark, rows, half=E.pinball(0.5), mae=E.mae(), zone=E.deadzone(0), a=E.tolerance_accuracy(1), b=E.tolerance_accuracy(2)
    )
    assert row["half"] == pytest.approx(row["mae"] / 2) and row["zone"] == pytest.approx(row["mae"])
    assert row["a"] <= row["b"]


def board(spark, rows):
    df = spark.createDataFrame(rows, "model string, split string, MAE double, RMSE double")
    return {r["model"]: r for r in L.leaderboard(df).collect()}


def test_leaderboard_ranks_and_lifts(spark):
    rows = [(m, s, v, v) for m, v in (("Naive_Last", 10.0), ("a", 5.0), ("b", None)) for s in ("train", "val", "test")]
    found = board(spark, rows)
    assert [found[m]["rank"] for m in ("a", "Naive_Last", "b")] == [1, 2, 3]
    assert found["a"]["Lift_val_MAE"] == 0.5 and found["b"]["Lift_val_MAE"] is None
    assert found["Naive_Last"]["Lift_test_MAE"] == 0.0


def test_no_lift_without_naive(spark):
    found = board(spark, [("a", "val", 5.0, 6.0), ("b", "val", 5.0, 5.5)])
    assert [found[m]["rank"] for m in ("b", "a")] == [1, 2]
    assert all(r["Lift_val_MAE"] is None for r in found.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "split string, dow int, hour int, steps_t double")


@pytest.mark.parametrize("how,cell,whole", [("mean", 2.0, 4.0), ("median", 1.0, 2.5), ("mode", 1.0, 1.0)])
def test_calendar_forecast(spark, how, cell, whole):
    train = [("train", 0, 1, v) for v in (1.0, 1.0, 4.0)] + [("train", 0, 2, 10.0), ("train", 0, 3, None)]
    rows = frame(spark, [*train, ("test", 0, 1, 0.0), ("test", 5, 5, 0.0), ("test", None, 1, 0.0)])
    found = baselines.calendar_forecast(rows, how).where("split = 'test'").collect()
    assert [r["yhat"] for r in sorted(found, key=lambda r: (r["dow"] is None, r["dow"]))] == [cell, whole, whole]


def test_calendar_forecast_fallbacks(spark):
    nowhere = frame(spark, [("train", None, None, 3.0), ("train", None, None, 5.0), ("test", 1, 1, 0.0)])
    assert {r["yhat"] for r in baselines.calendar_forecast(nowhere, "mean").collect()} == {4.0}
    nothing = frame(spark, [("train", 1, 1, None), ("test", 1, 1, 0.0)])
    assert {r["yhat"] for r in baselines.calendar_forecast(nothing, "median").collect()} == {0.0}
    with pytest.raises(ValueError):
        baselines.calendar_forecast(nothing, "max")


def test_own_statistic(spark):
    rows = frame(spark, [("train", 0, 1, v) for v in (1.0, 9.0)])
    assert {r["yhat"] for r in baselines.calendar_forecast(rows, F.max).collect()} == {9.0}


def test_naive_needs_the_lag(signal):
    with pytest.raises(ValueError):
        baselines.naive_forecast(signal)


def test_priors_come_from_train_only(spark):
    rows = spark.createDataFrame(
        [(1, "train", 0, 1, 2.0), (1, "train", 0, 1, 4.0), (1, "test", 0, 1, 100.0), (2, "test", 0, 1, 7.0)],
        "user_id long, split string, dow int, hour int, steps_t double",
    )
    found = {(r["user_id"], r["steps_t"]): r["prior_usr_dow_hour"] for r in baselines.add_user_prior(rows).collect()}
    assert found[(1, 100.0)] == 3.0 and found[(2, 7.0)] is None


def test_weights(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 80.0, 240.0, 400.0, 401.0, 1e6)], "y double")
    y = F.col("y")
    rows = df.select(
        W.band_weight(y, 80, 400, 1.5).alias("band"), W.power_weight(y, 200, 1, 3).alias("power"), W.active_weight(y).alias("active")
    ).collect()
    assert [r["band"] for r in rows] == [1, 1, 1, 1.25, 1.5, 1, 1]
    assert [r["power"] for r in rows] == pytest.approx([1.025, 1, 1.4, 2.2, 3, 3.005, 4])
    assert [r["active"] for r in rows] == [1, 1, 3, 3, 3, 3, 3]
    back = df.select(W.expm1_clipped(W.log1p_clipped(y)).alias("z")).collect()
    assert [r["z"] for r in back] == pytest.approx([0, 0, 80, 240, 400, 401, 1e6])


def example(spark, n):
    rows = spark.range(n).select(
        F.lit(1).alias("user_id"),
        F.col("id").alias("event_id"),
        F.timestamp_add("HOUR", F.col("id") * 2, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        F.col("id").cast("double").alias("steps"),
        F.lit(-1.0).alias("yhat"),
    )
    return examples.gap_example(rows).orderBy("position").collect()


@pytest.mark.parametrize("n,points,hidden", [(9, 0, 0), (10, 10, 8), (100, 100, 8), (400, 168, 8)])
def test_gap_example(spark, n, points, hidden):
    rows = example(spark, n)
    middle = [r["position"] for r in rows if r["hidden"]]
    assert (len(rows), len(middle)) == (points, hidden)
    if middle:
        start = (points - hidden) // 2
        assert middle == list(range(start, start + hidden))
        assert all((r["observed_steps"] is None) == r["hidden"] for r in rows)
        assert all((r["filled_steps"] == -1.0) == r["hidden"] for r in rows)


def test_gap_example_picks_a_user(spark, signal):
    predicted = signal.withColumn("yhat", F.lit(0.0))
    order = [r["user_id"] for r in signal.groupBy("user_id").agg(F.min("ts").alias("t")).orderBy("t").collect()]
    assert {r["user_id"] for r in examples.gap_example(predicted, user_rank=2).collect()} == {order[2]}
    assert {r["user_id"] for r in examples.gap_example(predicted, user_rank=10_000).collect()} == {order[-1]}


def test_profile_edges(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.0), (1, "2024-01-01 05:00:00", None)], "user_id long, ts string, steps double")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    user = profile.per_user_table(rows).first()
    assert (user["rows"], user["days"], user["mean_steps"], user["zero_frac"]) == (2, 1, 0.0, 0.5)
    summary = profile.summary_row(rows, active_threshold=0).first()
    assert (summary["active_fraction"], summary["hr_col_present"], summary["hr_coverage"]) == (0.5, False, None)
    hours = {r["hour"]: r for r in profile.hour_of_day_table(rows).collect()}
    assert (hours[0]["median"], hours[0]["std"], hours[5]["count"], hours[5]["median"]) == (0.0, None, 0, None)
    assert profile.summary_row(rows.limit(0)).first()["n_rows"] == 0


def test_profile_job(spark, signal, tmp_path):
    tables = profile_tables(signal, sample_rows=10)
    assert tables["dataset_sample"].count() == 10 and tables["summary"].count() == 10
    paths = run_profile(signal, str(tmp_path / "report"), sample_rows=10)
    assert spark.read.option("header", True).csv(paths["dataset_flat"]).count() == signal.count()
    renamed = profile_tables(signal.withColumnsRenamed({"steps": "steps_t", "hr": "heart_rate"}))
    assert renamed["summary"].collect() == tables["summary"].collect()
