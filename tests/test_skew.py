"""Long series take another path and must come out the same."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import assert_same
from pulsegrid.layout import DEFAULT_LAYOUT
from pulsegrid.operators import examples, filters, series as S, splits
from pulsegrid.operators.skew import (
    HotKeys,
    add_series_columns,
    find_hot_keys,
    join_by_key,
    no_hot_keys,
    number_in_series,
    number_rows,
)
from pulsegrid.plans.features import FeatureSettings, build_features

PLAIN = no_hot_keys()
SPECS = S.combine(
    [
        S.lag_columns("steps", (1, 3, 8)),
        S.rolling_columns("hr", (4, 16)),
        S.rolling_columns("steps", (4, 16), past_only=True),
        S.gap_column(),
        S.target_column("steps", 5),
    ]
)


def test_blocks_equal_plain_windows(signal, hot):
    assert_same(add_series_columns(signal, SPECS, hot=PLAIN), add_series_columns(signal, SPECS, hot=hot))


@pytest.mark.parametrize("block_rows", [1, 16, 10_000])
def test_block_size_does_not_matter(signal, hot, block_rows):
    """Blocks are never smaller than the reach of the expressions."""
    sized = replace(hot, block_rows=block_rows)
    assert_same(add_series_columns(signal, SPECS, hot=PLAIN), add_series_columns(signal, SPECS, hot=sized))


def test_everything_hot(signal):
    every = HotKeys("user_id", everything=True, block_rows=9)
    assert_same(add_series_columns(signal, SPECS, hot=PLAIN), add_series_columns(signal, SPECS, hot=every))


def test_more_hot_keys_than_the_list_holds(signal):
    found = find_hot_keys(signal, hot_rows=1, list_size=3, block_rows=20)
    assert found.everything
    assert_same(number_in_series(signal, hot=PLAIN), number_in_series(signal, hot=found))


def test_no_hot_keys_by_default(signal):
    assert not find_hot_keys(signal)


def test_missing_key_can_be_hot(spark, signal):
    rows = signal.withColumn("user_id", F.when(F.col("user_id") > 4, F.col("user_id")))
    found = find_hot_keys(rows, hot_rows=200, block_rows=11)
    assert found.values == (None,)
    spec = S.lag_columns("steps", (1, 2))
    assert_same(add_series_columns(rows, spec, hot=PLAIN), add_series_columns(rows, spec, hot=found))


def test_dominating_series_spreads_over_blocks(spark):
    """A third of all rows in one series: no block task holds more than block plus halo."""
    events = spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("user_id"),
        F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        (F.col("id") % 17).cast("double").alias("steps"),
    )
    found = find_hot_keys(events, hot_rows=500, block_rows=100)
    assert found.values == (0,)
    spec = S.rolling_columns("steps", (4, 16), past_only=True)
    assert_same(add_series_columns(events, spec, hot=PLAIN), add_series_columns(events, spec, hot=found))


def test_number_in_series(signal, hot):
    assert_same(number_in_series(signal, hot=PLAIN), number_in_series(signal, hot=hot))


def test_number_rows_is_the_total_order(signal):
    rows = number_rows(signal, ["ts", "event_id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(len(rows)))
    assert [(r["ts"], r["event_id"]) for r in rows] == sorted((r["ts"], r["event_id"]) for r in rows)


def test_equal_times_are_ordered_by_the_tie_break(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(40)], "user_id long, event_id long, steps double")
    rows = rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    every = HotKeys("user_id", everything=True, block_rows=5)
    lagged = add_series_columns(rows, S.lag_columns("steps", (1,)), hot=every).orderBy("event_id").collect()
    assert [r["steps_lag1"] for r in lagged] == [None, *[float(i) for i in range(39)]]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_join_by_key(signal, hot, how):
    lookup = signal.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("steps").alias("least"))
    assert_same(join_by_key(signal, lookup, "user_id", how), join_by_key(signal, lookup, "user_id", how, hot))


def test_splits_filters_features_and_examples(signal, hot):
    assert_same(splits.split_share_of_days(signal), splits.split_share_of_days(signal, hot=hot))
    assert_same(splits.split_last_days(signal, 5, 6), splits.split_last_days(signal, 5, 6, hot=hot))
    assert_same(filters.min_samples(signal, 66), filters.min_samples(signal, 66, hot=hot))
    for steps in (True, False):
        settings = FeatureSettings(user_id_encoding="drop", allow_step_inputs=steps, lags=(1, 4), roll_windows=(4,))
        assert_same(build_features(signal, settings, hot=PLAIN), build_features(signal, settings, hot=hot))
    predicted = signal.withColumn("yhat", F.lit(1.0))
    assert_same(examples.gap_example(predicted, hot=PLAIN), examples.gap_example(predicted, hot=hot))


def test_one_exchange_for_all_window_stages(signal):
    plan = build_features(signal, FeatureSettings(allow_step_inputs=True, user_id_encoding="drop"), hot=PLAIN)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1


def test_layout_order():
    assert DEFAULT_LAYOUT.full_order == ["user_id", "ts", "event_id"]


@pytest.mark.parametrize("step", [None, 45])
def test_a_feature_job_writes_long_series_once(signal, hot, monkeypatch, step):
    """One ordering and one write for all stages, and halos reach back over blocks that a filter has emptied."""
    from pulsegrid.operators import skew
    from pulsegrid.plans.features import FeatureSettings, build_features

    wide = replace(hot, block_rows=3)
    written = []
    freeze = skew.freeze
    monkeypatch.setattr(skew, "freeze", lambda *a, **k: written.append(1) or freeze(*a, **k))
    settings = FeatureSettings(user_id_encoding="drop", lags=(1, 3), roll_windows=(4,), strict_step_minutes=step)
    rows = signal.where("event_id % 7 > 0") if step is None else signal
    assert_same(build_features(rows, settings, hot=wide), build_features(rows, settings, hot=no_hot_keys()))
    assert len(written) == 1


def test_rows_kept_far_apart_still_see_each_other(signal, hot):
    from pulsegrid.operators.skew import DividedSeries

    lagged = lambda hot: (
        DividedSeries.divide(signal, hot=hot).add(S.lag_columns("steps", [2])).keep(lambda df: df.where("event_id % 11 = 0"))
        .add(S.lag_columns("hr", [1, 4])).together()
    )
    assert_same(lagged(replace(hot, block_rows=4)), lagged(no_hot_keys()))
