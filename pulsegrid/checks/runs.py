"""Queries: whole jobs whose models have a closed form, and the chain from matrix cells to features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.checks import tables
from pulsegrid.checks.common import SIGNAL, check, day_text, round_columns, rounded, signal, sql_round, sql_rounded
from pulsegrid.checks.forecasts import PAIRS, _predict_sql, split_signal
from pulsegrid.checks.tables import SHARE_SPLIT
from pulsegrid.operators import baselines, metrics
from pulsegrid.operators.skew import HotKeys, find_hot_keys, number_in_series
from pulsegrid.plans.features import FeatureSettings, build_features
from pulsegrid.plans.train import RunSettings, rescore_run, train_and_compare
from pulsegrid.session import freeze, scratch_path
from pulsegrid.sources import signal as source

# One input, the previous value, so that the linear model is a line in closed form.
_FEATURES = FeatureSettings(
    allow_step_inputs=True, use_hr=False, lags=(1,), roll_windows=(), calendar=("dow", "hour"), slot_and_day=False,
    gap=False, user_id_encoding="drop",
)
_OTHERS = ("user_id", "row_idx", "hr", "dow", "hour")
_MODELS = {"averaging": "mean", "median": "median", "mode": "mode"}

# The feature table of the run: the next value as target, the previous one as input, split by share of days.
RUN_BASE = f"""{SIGNAL.replace("sig AS (", "sig0 AS (")},
aimed AS (SELECT *, lead(steps) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS steps_t FROM sig0),
sig AS (SELECT *, lag(steps) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS steps_lag1
        FROM aimed WHERE steps_t IS NOT NULL),
{SHARE_SPLIT.replace("events", "sig")},
base AS (
  SELECT s.user_id, event_id, ts, steps_t, steps_lag1, split, CAST(coalesce(steps_lag1, 0) AS FLOAT)::DOUBLE AS x,
         CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS "hour"
  FROM sig s JOIN parts p ON s.user_id = p.user_id AND s.date = p.day
),
line AS (SELECT avg(x) AS mx, avg(steps_t) AS my, covar_pop(x, steps_t) / var_pop(x) AS slope FROM base WHERE split = 'train'),
linreg AS (SELECT base.*, my + (x - mx) * slope AS yhat FROM base, line)"""

_COLUMNS = ["MAE_train", "MAE_val", "RMSE_val", "MAE_test", "RMSE_test", "Lift_val_MAE", "Lift_test_MAE"]


def _board_sql(models: list[str]) -> str:
    fitted = "".join(f", {_predict_sql(how, name)}" for name, how in _MODELS.items() if name in models)
    pairs = ["SELECT 'naive_last' AS model, split, steps_t AS y, steps_lag1 AS yhat FROM base"]
    pairs += [f"SELECT '{name}', split, steps_t, yhat FROM {name}" for name in models]
    part = lambda value, s: f"{value} FILTER (split = '{s}')"
    errors = [f"{part('avg(abs(y - yhat))', s)} AS MAE_{s}" for s in ("train", "val", "test")]
    errors += [f"sqrt({part('avg((y - yhat) * (y - yhat))', s)}) AS RMSE_{s}" for s in ("val", "test")]
    lift = lambda s: f"(n.MAE_{s} - e.MAE_{s}) / n.MAE_{s} AS Lift_{s}_MAE"
    return f"""WITH {RUN_BASE}{fitted}, pairs AS ({' UNION ALL '.join(pairs)}),
errors AS (SELECT model, {', '.join(errors)} FROM pairs GROUP BY model),
board AS (SELECT CAST(row_number() OVER (ORDER BY e.MAE_val, e.RMSE_val, e.model) AS INTEGER) AS "rank", e.*,
          {lift('val')}, {lift('test')} FROM errors e, (SELECT * FROM errors WHERE model = 'naive_last') n)
SELECT "rank", model, {sql_rounded(_COLUMNS, 4)} FROM board"""


def _settings(run_id: str, models: list[str]) -> RunSettings:
    return RunSettings(run_id, models={m: {} for m in models}, tolerances=(50,), exclude=_OTHERS)


def _board(board: DataFrame) -> DataFrame:
    return round_columns(board.select("rank", "model", *_COLUMNS), _COLUMNS, 4)


@check("train_run", _board_sql([*_MODELS, "linreg"]))
def train_run(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines and a linear model through the whole job."""
    features = build_features(signal(spark, sf), _FEATURES)
    return _board(train_and_compare(features, _settings("check", ["naive_last", *_MODELS, "linreg"])).board)


@check("rescore_run", _board_sql(["linreg"]))
def rescore(spark: SparkSession, sf: str) -> DataFrame:
    """A run with a folder of its own, then its saved models scored again."""
    folder = scratch_path(spark, f"run-{uuid.uuid4().hex}")
    features = freeze(build_features(signal(spark, sf), _FEATURES))
    train_and_compare(features, _settings("rescore", ["linreg"]), folder)
    return _board(rescore_run(spark, folder, features, tolerances=(25, 100)).board)


@check("resumed_run", _board_sql(["linreg"]).replace("FROM board", "FROM board WHERE model = 'linreg'"))
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run resumed from its saved model: the same errors, recorded once."""
    folder, results = scratch_path(spark, "resumed"), scratch_path(spark, "resumed-results")
    features = freeze(build_features(signal(spark, sf), _FEATURES))
    settings = _settings("resumed", ["naive_last", "linreg"])
    train_and_compare(features, settings, folder, results)
    board = train_and_compare(features, settings, folder, results, resume=True).board
    once = spark.read.parquet(results).where("run_id = 'resumed'").groupBy("model").count().where("count = 1")
    return _board(board.where("model = 'linreg'").join(once, "model", "left_semi"))


@check(
    "run_examples",
    f"""WITH {RUN_BASE}, {_predict_sql('median', 'median')},
two AS (SELECT 'naive_last' AS model, event_id, ts, user_id, steps_t AS y, steps_lag1 AS yhat FROM base WHERE split = 'test'
         UNION ALL SELECT 'median', event_id, ts, user_id, steps_t, yhat FROM median WHERE split = 'test'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id, user_id) AS r FROM two)
SELECT model, event_id, {sql_round('y', 4)} AS y, {sql_round('yhat', 4)} AS yhat FROM numbered WHERE r <= 500""",
)
def run_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first scored test rows of every model, as the run has written them."""
    folder = scratch_path(spark, "examples")
    features = build_features(signal(spark, sf), _FEATURES)
    train_and_compare(features, _settings("examples", ["naive_last", "median"]), folder)
    parts = []
    for model in ("naive_last", "median"):
        read = spark.read.option("header", True).csv(f"{folder}/examples/{model}_first_scored")
        number = lambda c: rounded(F.col(c).cast("double"), 4).alias(c)
        parts.append(read.select(F.lit(model).alias("model"), F.col("event_id").cast("bigint"), number("y"), number("yhat")))
    return metrics.stack_scored(parts)


@check(
    "daily_naive",
    f"""WITH {SIGNAL}, days AS (SELECT user_id, "date" AS "day", sum(steps) AS total FROM sig GROUP BY ALL),
aimed AS (SELECT *, lead(total) OVER w AS steps_t, lag(total) OVER w AS yhat FROM days WINDOW w AS (PARTITION BY user_id ORDER BY "day"))
SELECT user_id, strftime("day", '%Y-%m-%d') AS "day", {sql_rounded(['steps_t', 'yhat'], 4)} FROM aimed WHERE steps_t IS NOT NULL""",
)
def daily_naive(spark: SparkSession, sf: str) -> DataFrame:
    """The previous day's total as forecast of the next day's."""
    rows = build_features(signal(spark, sf), FeatureSettings(task="daily_total", user_id_encoding="drop"))
    found = baselines.naive_forecast(rows, "ref_prev").select("user_id", day_text("day").alias("day"), "steps_t", "yhat")
    return round_columns(found, ["steps_t", "yhat"], 4)


_PER_USER = [f"P{p}_abs_err" for p in metrics.PERCENTILES]


@check(
    "error_percentiles_per_user",
    f"""WITH {PAIRS.replace("'median' AS model, split,", "user_id,")},
found AS (SELECT user_id, {', '.join(f'quantile_cont(abs(y - yhat), {p / 100}) AS "P{p}_abs_err"' for p in metrics.PERCENTILES)}
          FROM pairs GROUP BY user_id)
SELECT user_id, {sql_rounded(_PER_USER, 5)} FROM found""",
)
def error_percentiles_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """As many groups as users: joined, not broadcast."""
    rows = baselines.calendar_forecast(split_signal(spark, sf), "median")
    scored = metrics.scored_columns(rows, "median", ref="steps_lag1", keep=["user_id"])
    return round_columns(metrics.error_percentiles(scored, by=["user_id"]), _PER_USER, 5)


@check(
    "series_position_null_key",
    """WITH keyed AS (SELECT CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id, event_id, ts FROM events),
placed AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS p FROM keyed)
SELECT event_id, p AS plain, p AS listed, p AS everything FROM placed""",
)
def series_position_null_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a key are a series like any other, whatever path measures them."""
    key = F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    rows = signal(spark, sf).select(key.alias("user_id"), "event_id", "ts")
    paths = {
        "plain": find_hot_keys(rows),
        "listed": find_hot_keys(rows, hot_rows=66, block_rows=1000),
        "everything": HotKeys("user_id", everything=True),
    }
    found = rows.select("event_id")
    for name, hot in paths.items():
        found = found.join(number_in_series(rows, name=name, hot=hot).select("event_id", name), "event_id")
    return found


@check(
    "features_matrix",
    """WITH cells AS (
  SELECT vec_id AS user_id, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx,
         CAST(embedding[r * 8 + c + 1] AS DOUBLE) AS steps
  FROM embeddings, range(8) AS r_(r), range(8) AS c_(c) WHERE vec_id % 5 <> 0),
aimed AS (SELECT *, lead(steps) OVER (PARTITION BY user_id ORDER BY col_idx, row_idx) AS steps_t FROM cells)
SELECT user_id, row_idx, col_idx, steps, steps_t, lag(steps) OVER (PARTITION BY user_id ORDER BY col_idx, row_idx) AS ref_prev
FROM aimed WHERE steps_t IS NOT NULL""",
)
def features_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Nested cells to signal to features; the layout follows from the columns."""
    cells = source.explode_cells(tables._cells(spark, sf), min_days=8)
    rows = build_features(cells, FeatureSettings(user_id_encoding="drop", lags=(1,), roll_windows=()))
    return rows.select("user_id", "row_idx", "col_idx", "steps", "steps_t", "ref_prev")
