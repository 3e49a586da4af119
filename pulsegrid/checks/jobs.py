"""Queries: readers and writers, whole comparison table, and the path for long series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.checks import tables
from pulsegrid.checks.common import CHECKS, check, day_text, round_columns, rounded, signal, sql_rounded
from pulsegrid.checks.forecasts import (
    BOARD,
    PAIRS,
    SQL_MEASURES,
    _median_scored,
    _naive_scored,
    scored_baselines,
    split_signal,
)
from pulsegrid.checks.models import _ONE_INPUT
from pulsegrid.models.registry import make_model
from pulsegrid.models.store import load_model, save_model
from pulsegrid.operators import leaderboard, metrics, profile, series, splits
from pulsegrid.operators.skew import HotKeys, add_series_columns, find_hot_keys, number_in_series
from pulsegrid.plans.build import build_signal
from pulsegrid.plans.profile import run_profile
from pulsegrid.session import scratch_path
from pulsegrid.sources import sinks


# ---------------------------------------------------------------- readers and writers


@check("build_job", CHECKS["matrix_explode"].sql)
def build_job(spark: SparkSession, sf: str) -> DataFrame:
    """Nested cells written as a table, read, exploded, sorted, written and read back."""
    folder = scratch_path(spark, "build")
    sinks.write_table(tables._cells(spark, sf), f"{folder}/cells")
    rows = build_signal(spark, f"{folder}/cells", f"{folder}/signal", min_days=8)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(
        "user_id", "row_idx", "col_idx", day_text("date").alias("date"), micros.alias("ts_micros"), "steps", "hr"
    )


@check("csv_table", CHECKS["profile_user_day"].sql)
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    days = profile.user_day_table(signal(spark, sf), slot_minutes=360)
    sinks.write_csv(days.withColumn("date", day_text("date")), path)
    return spark.read.schema("user_id long, date string, rows long, complete int").option("header", True).csv(path)


@check(
    "results_table",
    f"""WITH {BOARD}, runs AS (SELECT 'first' AS run_id UNION ALL SELECT 'second')
SELECT run_id, model, {sql_rounded(['MAE_val', 'MAE_test'], 5)} FROM board, runs""",
)
def results_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs in one table, the first recorded twice."""
    path = scratch_path(spark, "results")
    board = leaderboard.compare(metrics.evaluate(scored_baselines(spark, sf), percentiles=()))
    rows = board.select("model", "MAE_val", "MAE_test")
    for run in ("first", "second", "first"):
        sinks.append_results(rows.withColumn("run_id", F.lit(run)), path)
    return round_columns(sinks.read_results(spark, path).select("run_id", "model", "MAE_val", "MAE_test"), ["MAE_val", "MAE_test"], 5)


@check(
    "report_tables",
    """SELECT 'summary' AS name, CAST(10 AS BIGINT) AS rows
UNION ALL SELECT 'per_user', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'hour_of_day', count(DISTINCT hour(ts)) FROM events
UNION ALL SELECT 'prior_user_dow_hour', count(DISTINCT (user_id, isodow(ts), hour(ts))) FROM events
UNION ALL SELECT 'by_user_day', count(DISTINCT (user_id, CAST(ts AS DATE))) FROM events
UNION ALL SELECT 'dataset_sample', least(count(*), 100000) FROM events
UNION ALL SELECT 'dataset_flat', count(*) FROM events""",
)
def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of the profile report written as CSV, and their sizes on reading them back."""
    paths = run_profile(signal(spark, sf), scratch_path(spark, "report"))
    sizes = None
    for name, path in paths.items():
        read = spark.read.option("header", True).csv(path)
        one = read.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes


@check("saved_model", _ONE_INPUT.replace("{0}", "0"))
def saved_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted, saved, loaded and applied."""
    from pyspark.ml.feature import VectorAssembler

    rows = split_signal(spark, sf).withColumns({"x": F.coalesce("steps_lag1", F.lit(0.0)), "label": F.col("steps_t")})
    frame = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    path = scratch_path(spark, "model")
    save_model(spark, make_model("linreg").fit(frame.where(F.col("split") == "train")), path)
    again = load_model(spark, path).transform(frame)
    return again.select("event_id", "split", rounded("yhat", 3).alias("yhat"))


# ---------------------------------------------------------------- whole comparison table

_MEASURES = [
    "MAE", "RMSE", "MAPE", "R2", "WAPE", "SMAPE", "MAPE_safe", "ToleranceAcc@50", "DirectionalAcc",
    *[f"P{p}_abs_err" for p in metrics.PERCENTILES],
]
_WIDE = ["MAE_train", *[f"{m}_{s}" for s in ("val", "test") for m in _MEASURES]]


def _comparison_sql() -> str:
    pieces = ["max(\"MAE\") FILTER (split = 'train') AS \"MAE_train\""]
    pieces += [f"max(\"{m}\") FILTER (split = '{s}') AS \"{m}_{s}\"" for s in ("val", "test") for m in _MEASURES]
    measures = ", ".join(f'{SQL_MEASURES[m]} AS "{m}"' for m in _MEASURES)
    both = f"WITH {PAIRS}, naive AS (SELECT 'naive_last' AS model, split, steps_t AS y, steps_lag1 AS yhat, steps_lag1 AS ref_prev FROM base)"
    return f"""{both},
measured AS (SELECT model, split, {measures} FROM (SELECT * FROM pairs UNION ALL SELECT * FROM naive) GROUP BY model, split),
wide AS (SELECT model, {', '.join(pieces)} FROM measured GROUP BY model)
SELECT model, {sql_rounded(_WIDE, 5)} FROM wide"""


@check("comparison_table", _comparison_sql())
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every measure of two models on validation and test, one row per model."""
    scored = metrics.stack_scored([_median_scored(spark, sf), _naive_scored(spark, sf)])
    wide = leaderboard.compare(metrics.evaluate(scored, [50]).drop("n_scored", "n_missing"))
    return round_columns(wide.select("model", *_WIDE), _WIDE, 5)


# ---------------------------------------------------------------- long series

# Thresholds far below the defaults send about half of the users down the path for long series.
_LONG, _BLOCK = 66, 1000


@check("long_series_rolling", CHECKS["rolling_past_only"].sql)
def long_series_rolling(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    hot = find_hot_keys(rows, hot_rows=_LONG, block_rows=_BLOCK)
    names = tables._ROLLED
    return round_columns(series.make_rolls(rows, past_only=True, hot=hot).select("event_id", *names), names)


@check("long_series_lags", CHECKS["lags"].sql)
def long_series_lags(spark: SparkSession, sf: str) -> DataFrame:
    """All series in blocks, as when too many are long to list them."""
    hot = HotKeys("user_id", everything=True, block_rows=_BLOCK)
    both = series.lag_columns("steps") + series.lag_columns("hr")
    rows = add_series_columns(signal(spark, sf), both, hot=hot)
    return rows.select("event_id", *tables._ALL_LAGS)


@check("long_series_target", CHECKS["target_interval"].sql)
def long_series_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    hot = find_hot_keys(rows, hot_rows=_LONG, block_rows=_BLOCK)
    targets = [series.target_column("steps", h, f"steps_t{h}") for h in (0, 1, 4)]
    return add_series_columns(rows, series.combine(targets), hot=hot).select("event_id", "steps_t0", "steps_t1", "steps_t4")


@check("long_series_split", CHECKS["split_pct"].sql)
def long_series_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    hot = find_hot_keys(rows, hot_rows=_LONG)
    return splits.split_share_of_days(rows, hot=hot).select("event_id", "user_id", "split")


@check(
    "series_position",
    """SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS position
FROM events""",
)
def series_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf).select("user_id", "event_id", "ts")
    return number_in_series(rows, hot=find_hot_keys(rows, hot_rows=_LONG)).select("event_id", "position")
