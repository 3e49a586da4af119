from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from helpers import rows_of
from pulsegrid.operators import series as S
from pulsegrid.operators.skew import no_hot_keys
from pulsegrid.plans.features import FeatureSettings, build_features

PLAIN = no_hot_keys()


def test_strict_features_ignore_the_present_and_the_future(signal):
    """Changing every value from one moment on must not change strict inputs at or before that moment."""
    cut = signal.agg(F.expr("CAST(percentile_approx(unix_micros(CAST(ts AS timestamp)), 0.5) AS BIGINT)")).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= cut
    changed = signal.withColumns({c: F.when(late, F.col(c) * 7 + 1).otherwise(F.col(c)) for c in ("steps", "hr")})
    inputs = ["event_id", *[f"hr_lag{n}" for n in S.DEFAULT_LAGS], *[f"hr_{s}_{n}" for n in (4, 16, 64) for s in ("max", "mean", "std")]]

    def early(df):
        # the first late row still looks at early rows only
        first = F.row_number().over(Window.partitionBy("user_id", late).orderBy("ts", "event_id"))
        return build_features(df, hot=PLAIN).withColumn("_n", first).where(~late | (F.col("_n") == 1)).select(*inputs)

    assert rows_of(early(signal)) == rows_of(early(changed))


def series_of(spark, values):
    df = spark.createDataFrame([(1, i, v, h) for i, (v, h) in enumerate(values)], "user_id long, event_id long, steps double, hr double")
    return df.withColumn("ts", F.timestamp_add("MINUTE", F.col("event_id") * 15, F.lit("2024-01-01").cast("timestamp_ntz")))


def test_missing_values_take_a_place_in_the_window(spark):
    df = series_of(spark, [(1.0, None), (2.0, 4.0), (None, None), (4.0, 8.0)])
    rows = S.make_rolls(df, windows=(2,), hot=PLAIN).orderBy("event_id").collect()
    assert [r["steps_mean_2"] for r in rows] == [1.0, 1.5, 2.0, 4.0]
    assert [r["hr_mean_2"] for r in rows] == [None, 4.0, 4.0, 8.0]
    assert rows[0]["steps_std_2"] is None and rows[1]["steps_std_2"] == pytest.approx(0.5**0.5)


def test_single_row_and_all_missing(spark):
    one = build_features(series_of(spark, [(1.0, None)]), FeatureSettings(user_id_encoding="drop", horizon=0), hot=PLAIN).collect()
    assert len(one) == 1 and one[0]["hr_max_4"] is None and one[0]["steps_t"] == 1.0
    none = build_features(series_of(spark, [(1.0, None), (2.0, None)]), FeatureSettings(user_id_encoding="drop", horizon=3), hot=PLAIN)
    assert none.count() == 0


def test_columns_that_are_absent_are_passed_over(spark):
    df = series_of(spark, [(1.0, 1.0)]).drop("hr")
    assert "hr_mean_4" not in S.make_rolls(df, hot=PLAIN).columns


def test_delta_needs_the_first_lag(spark):
    df = series_of(spark, [(1.0, 1.0), (2.0, 3.0)])
    with_lag = build_features(df, FeatureSettings(user_id_encoding="drop", horizon=0, lags=(1,)), hot=PLAIN).orderBy("event_id").collect()
    assert with_lag[1]["hr_delta1"] == 2.0
    assert "hr_delta1" not in build_features(df, FeatureSettings(user_id_encoding="drop", horizon=0, lags=(2,)), hot=PLAIN).columns


def test_daily_task(spark):
    df = series_of(spark, [(float(i), 60.0 if i % 2 else None) for i in range(96 * 3)])
    rows = build_features(df, FeatureSettings(task="daily_total", user_id_encoding="drop"), hot=PLAIN).orderBy("day").collect()
    totals = [sum(range(96 * d, 96 * (d + 1))) for d in range(3)]
    assert [r["steps"] for r in rows] == totals[:2] and [r["steps_t"] for r in rows] == totals[1:]
    assert [str(r["ts"]) for r in rows] == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]


def test_encodings(signal):
    settings = FeatureSettings(user_id_encoding="drop", lags=(1,), roll_windows=())
    users = signal.select("user_id").distinct().count()
    wide = build_features(signal, FeatureSettings(**{**settings.__dict__, "user_id_encoding": "onehot"}), hot=PLAIN)
    assert sum(c.startswith("user_id_") for c in wide.columns) == users - 1
    with pytest.raises(ValueError):
        build_features(signal, FeatureSettings(user_id_encoding="hash"), hot=PLAIN)
    with pytest.raises(ValueError):
        build_features(signal, FeatureSettings(task="weekly"), hot=PLAIN)


def test_gaps_do_not_depend_on_the_session_zone(spark):
    from pulsegrid.operators.series import add_gap_minutes

    rows = [(1, 0, "2024-03-31 01:30:00"), (1, 1, "2024-03-31 03:30:00"), (1, 2, "2024-04-02 03:30:15.5")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t string").selectExpr(
        "user_id", "event_id", "cast(t as timestamp_ntz) as ts"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin"):  # clocks change on that night in Berlin
            spark.conf.set("spark.sql.session.timeZone", name)
            found = add_gap_minutes(df, hot=PLAIN).orderBy("event_id").collect()
            assert [r["delta_minutes_from_prev"] for r in found] == [None, 120.0, 2880.25 + 1 / 120]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
