"""Queries: forecasts without fitting, error measures, leaderboard, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.checks.common import SIGNAL, check, round_columns, rounded, signal, sql_round, sql_rounded
from pulsegrid.checks.tables import SHARE_SPLIT
from pulsegrid.operators import baselines, examples, leaderboard, metrics, series, sketches, splits
from pulsegrid.operators.skew import add_series_columns
from pulsegrid.session import freeze

# ---------------------------------------------------------------- shared inputs

# Signal with split, calendar, previous value and target (the current value).
SPLIT_SIGNAL = f"""{SIGNAL}, {SHARE_SPLIT},
base AS (
  SELECT s.user_id, event_id, ts, steps, steps AS steps_t, hr, split,
         CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS "hour",
         lag(steps) OVER (PARTITION BY s.user_id ORDER BY ts, event_id) AS steps_lag1
  FROM sig s JOIN parts p ON s.user_id = p.user_id AND s.date = p.day
)"""


def split_signal(spark: SparkSession, sf: str, lagged: bool = True) -> DataFrame:
    """Written once, because forecasts and measures read it several times."""
    rows = signal(spark, sf).withColumn("steps_t", F.col("steps"))
    if lagged:
        rows = add_series_columns(rows, series.lag_columns("steps", [1]))
    return freeze(splits.split_share_of_days(rows))


_CELLS = {
    "mean": 'SELECT dow, "hour", avg(steps_t) AS v FROM base WHERE split = \'train\' GROUP BY dow, "hour"',
    "median": 'SELECT dow, "hour", median(steps_t) AS v FROM base WHERE split = \'train\' GROUP BY dow, "hour"',
    "mode": """SELECT dow, "hour", steps_t AS v FROM (
      SELECT dow, "hour", steps_t, row_number() OVER (PARTITION BY dow, "hour" ORDER BY count(*) DESC, steps_t) AS r
      FROM base WHERE split = 'train' GROUP BY dow, "hour", steps_t) WHERE r = 1""",
}
_WHOLE = {
    "mean": "SELECT avg(steps_t) AS g FROM base WHERE split = 'train'",
    "median": "SELECT median(steps_t) AS g FROM base WHERE split = 'train'",
    "mode": """SELECT steps_t AS g FROM base WHERE split = 'train' GROUP BY steps_t
      ORDER BY count(*) DESC, steps_t LIMIT 1""",
}


def _predict_sql(how: str, name: str = "scored") -> str:
    return f"""cells_{name} AS ({_CELLS[how]}), whole_{name} AS ({_WHOLE[how]}),
{name} AS (
  SELECT b.*, CAST(CAST(coalesce(v, g, 0) AS FLOAT) AS DOUBLE) AS yhat
  FROM base b LEFT JOIN cells_{name} c ON b.dow = c.dow AND b."hour" = c."hour" CROSS JOIN whole_{name}
)"""


def _baseline(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = baselines.calendar_forecast(split_signal(spark, sf, lagged=False), how)
        return rows.select("event_id", "split", rounded("yhat", 4).alias("yhat"))

    return run


for _name, _how in (("baseline_mean", "mean"), ("baseline_median", "median"), ("baseline_mode", "mode")):
    check(
        _name,
        f"WITH {SPLIT_SIGNAL}, {_predict_sql(_how)} SELECT event_id, split, {sql_round('yhat', 4)} AS yhat FROM scored",
    )(_baseline(_how))


# A statistic of one's own: the mean of the least and the greatest value.
_MIDDLE = "(min(steps_t) + max(steps_t)) / 2"


@check(
    "baseline_own_statistic",
    f"""WITH {SPLIT_SIGNAL},
cells AS (SELECT dow, "hour", {_MIDDLE} AS v FROM base WHERE split = 'train' GROUP BY dow, "hour"),
whole AS (SELECT {_MIDDLE} AS g FROM base WHERE split = 'train')
SELECT event_id, split, {sql_round('CAST(CAST(coalesce(v, g, 0) AS FLOAT) AS DOUBLE)', 4)} AS yhat
FROM base LEFT JOIN cells USING (dow, "hour") CROSS JOIN whole""",
)
def baseline_own_statistic(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_signal(spark, sf, lagged=False)
    found = baselines.calendar_forecast(rows, lambda c: (F.min(c) + F.max(c)) / 2)
    return found.select("event_id", "split", rounded("yhat", 4).alias("yhat"))


# The forecast of cells never seen in train: train covers only the first hours of the day.
@check(
    "baseline_unseen_cells",
    f"""WITH {SIGNAL}, base AS (
  SELECT event_id, steps AS steps_t, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS "hour",
         CASE WHEN hour(ts) < 6 THEN 'train' ELSE 'test' END AS split FROM sig),
{_predict_sql('median')} SELECT event_id, {sql_round('yhat', 4)} AS yhat FROM scored""",
)
def baseline_unseen_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf).withColumn("steps_t", F.col("steps"))
    rows = rows.withColumn("split", F.when(F.hour("ts") < 6, "train").otherwise("test"))
    return baselines.calendar_forecast(rows, "median").select("event_id", rounded("yhat", 4).alias("yhat"))


@check(
    "user_prior_feature",
    f"""WITH {SPLIT_SIGNAL}, priors AS (
  SELECT user_id, dow, "hour", avg(steps_t) AS p FROM base WHERE split = 'train' GROUP BY ALL)
SELECT event_id, split, {sql_round('p')} AS prior_usr_dow_hour
FROM base b LEFT JOIN priors USING (user_id, dow, "hour")""",
)
def user_prior_feature(spark: SparkSession, sf: str) -> DataFrame:
    rows = baselines.add_user_prior(split_signal(spark, sf, lagged=False))
    return rows.select("event_id", "split", rounded("prior_usr_dow_hour").alias("prior_usr_dow_hour"))


@check("naive_last", f"WITH {SPLIT_SIGNAL} SELECT event_id, split, steps_lag1 AS yhat FROM base")
def naive_last(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.naive_forecast(split_signal(spark, sf)).select("event_id", "split", "yhat")


# ---------------------------------------------------------------- error measures

MEDIAN_SCORED = f"{SPLIT_SIGNAL}, {_predict_sql('median')}"
PAIRS = f"""{MEDIAN_SCORED},
pairs AS (SELECT 'median' AS model, split, steps_t AS y, yhat, steps_lag1 AS ref_prev FROM scored)"""
NAIVE_PAIRS = f"""{SPLIT_SIGNAL},
pairs AS (SELECT 'naive_last' AS model, split, steps_t AS y, steps_lag1 AS yhat, steps_lag1 AS ref_prev FROM base)"""


def _median_scored(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = baselines.calendar_forecast(split_signal(spark, sf), "median")
    return metrics.scored_columns(rows, "median", ref="steps_lag1", keep=keep)


def _naive_scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = baselines.naive_forecast(split_signal(spark, sf))
    return metrics.scored_columns(rows, "naive_last", ref="steps_lag1")


_KNOWN = "y IS NOT NULL AND yhat IS NOT NULL"
SQL_MEASURES = {
    "MAE": "avg(abs(y - yhat))",
    "RMSE": "sqrt(avg((y - yhat) * (y - yhat)))",
    "MAPE": "100 * avg(abs(y - yhat) / greatest(abs(y), 0.000001::DOUBLE))",
    "R2": f"1 - sum((y - yhat) * (y - yhat)) / nullif((var_pop(y) FILTER ({_KNOWN})) * (count(*) FILTER ({_KNOWN})), 0)",
    "WAPE": f"sum(abs(y - yhat)) / nullif(sum(abs(y)) FILTER ({_KNOWN}), 0)",
    "SMAPE": "200 * avg(abs(y - yhat) / greatest(abs(y) + abs(yhat) + 1, 1))",
    "MAPE_safe": "100 * avg(abs(y - yhat) / greatest(abs(y), 10))",
    "DirectionalAcc": "avg(CASE WHEN yhat IS NULL OR ref_prev IS NULL THEN NULL "
    "WHEN sign(y - ref_prev) = sign(yhat - ref_prev) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "ToleranceAcc@25": "avg(CASE WHEN abs(y - yhat) <= 25 THEN 1.0::DOUBLE WHEN yhat IS NOT NULL THEN 0 END)",
    "ToleranceAcc@50": "avg(CASE WHEN abs(y - yhat) <= 50 THEN 1.0::DOUBLE WHEN yhat IS NOT NULL THEN 0 END)",
    "ToleranceAcc@100": "avg(CASE WHEN abs(y - yhat) <= 100 THEN 1.0::DOUBLE WHEN yhat IS NOT NULL THEN 0 END)",
    "Pinball@0.5": "avg(greatest(0.5::DOUBLE * (y - yhat), (0.5::DOUBLE - 1) * (y - yhat)))",
    "Pinball@0.8": "avg(greatest(0.8::DOUBLE * (y - yhat), (0.8::DOUBLE - 1) * (y - yhat)))",
    "Deadzone@50": "avg(greatest(abs(y - yhat) - 50, 0))",
    "Deadzone2@50": "avg(power(greatest(abs(y - yhat) - 50, 0), 2))",
    **{f"P{p}_abs_err": f"quantile_cont(abs(y - yhat), {p / 100})" for p in (50, 75, 90, 95)},
}


def _measures_sql(pairs: str, names: list[str]) -> str:
    columns = ", ".join(f'{sql_round(SQL_MEASURES[n], 5)} AS "{n}"' for n in names)
    return f"WITH {pairs} SELECT model, split, {columns} FROM pairs GROUP BY model, split"


def _measures(scored: DataFrame, measures: dict) -> DataFrame:
    table = scored.groupBy("model", "split").agg(*[c.alias(n) for n, c in measures.items()])
    return round_columns(table, list(measures), 5)


@check("metrics_core", _measures_sql(PAIRS, ["MAE", "RMSE", "MAPE", "R2"]))
def metrics_core(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(_median_scored(spark, sf), metrics.core_measures())


@check("metrics_relative", _measures_sql(PAIRS, ["WAPE", "SMAPE", "MAPE_safe"]))
def metrics_relative(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(_median_scored(spark, sf), metrics.relative_measures())


@check("metrics_tolerance", _measures_sql(PAIRS, ["ToleranceAcc@25", "ToleranceAcc@50", "ToleranceAcc@100"]))
def metrics_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(_median_scored(spark, sf), metrics.tolerance_measures([25, 50, 100]))


@check("metrics_directional", _measures_sql(PAIRS, ["DirectionalAcc"]))
def metrics_directional(spark: SparkSession, sf: str) -> DataFrame:
    from pulsegrid.functions.errors import directional_accuracy

    return _measures(_median_scored(spark, sf), {"DirectionalAcc": directional_accuracy()})


@check("metrics_losses", _measures_sql(PAIRS, ["Pinball@0.5", "Pinball@0.8", "Deadzone@50", "Deadzone2@50"]))
def metrics_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(_median_scored(spark, sf), metrics.loss_measures())


_PERCENTILES = [f"P{p}_abs_err" for p in metrics.PERCENTILES]


@check("metrics_percentiles", _measures_sql(PAIRS, _PERCENTILES))
def metrics_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.error_percentiles(_median_scored(spark, sf)), _PERCENTILES, 5)


_ALL = ["MAE", "RMSE", "MAPE", "R2", "WAPE", "SMAPE", "MAPE_safe", "ToleranceAcc@50", "DirectionalAcc", *_PERCENTILES]


@check(
    "metrics_with_missing",
    _measures_sql(NAIVE_PAIRS, _ALL).replace(
        " FROM pairs",
        ", CAST(count(y - yhat) AS BIGINT) AS n_scored, CAST(count(*) - count(y - yhat) AS BIGINT) AS n_missing FROM pairs",
    ),
)
def metrics_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    """The naive forecast lacks each user's first row; those pairs are counted and left out."""
    return round_columns(metrics.evaluate(_naive_scored(spark, sf), [50]), _ALL, 5)


_SKETCHED = (0.5, 0.75, 0.9, 0.95)


@check(
    "error_percentiles_sketched",
    f"""WITH {PAIRS}, errors AS (SELECT split, count(*) AS n FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY split)
SELECT split, p, n, TRUE AS within_bound FROM errors, (SELECT unnest([0.5, 0.75, 0.9, 0.95])::DOUBLE AS p)""",
)
def error_percentiles_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches per user and split, merged to splits: the exact rank of every percentile is within the stated bound."""
    scored = freeze(_median_scored(spark, sf, keep=("user_id",)))
    by_user = freeze(sketches.error_sketches(scored, ["user_id", "split"]))
    merged = sketches.merge_sketches(by_user, ["split"])
    wanted = {f"q{i}": p for i, p in enumerate(_SKETCHED)}
    found = sketches.sketch_quantiles(merged, wanted, ["split"])
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.col(n).alias("value")) for n, p in wanted.items()])
    values = found.select("split", "n", F.inline(listed))
    errors = scored.select("split", F.abs(F.col("y") - F.col("yhat")).alias("e")).where("e IS NOT NULL")
    ranked = errors.join(F.broadcast(values), "split").groupBy("split", "p", "n").agg(
        F.avg((F.col("e") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("e") <= F.col("value")).cast("double")).alias("upto"),
    )
    bound = sketches.rank_error()
    within = (F.col("below") <= F.col("p") + bound) & (F.col("upto") >= F.col("p") - bound)
    return ranked.select("split", "p", "n", within.alias("within_bound"))


# ---------------------------------------------------------------- leaderboard

_MODELS = {"averaging": "mean", "median": "median", "mode": "mode"}
BOARD = f"""{SPLIT_SIGNAL},
{', '.join(_predict_sql(how, name) for name, how in _MODELS.items())},
pairs AS (
  SELECT 'naive_last' AS model, split, steps_t AS y, steps_lag1 AS yhat FROM base
  {' '.join(f"UNION ALL SELECT '{name}', split, steps_t, yhat FROM {name}" for name in _MODELS)}
),
errors AS (
  SELECT model,
    {', '.join(f"avg(abs(y - yhat)) FILTER (split = '{s}') AS MAE_{s}" for s in ('train', 'val', 'test'))},
    {', '.join(f"sqrt(avg((y - yhat) * (y - yhat)) FILTER (split = '{s}')) AS RMSE_{s}" for s in ('val', 'test'))}
  FROM pairs GROUP BY model
),
board AS (
  SELECT CAST(row_number() OVER (ORDER BY MAE_val NULLS LAST, RMSE_val NULLS LAST, model) AS INTEGER) AS "rank", *,
    ((SELECT MAE_val FROM errors WHERE model = 'naive_last') - MAE_val)
      / (SELECT MAE_val FROM errors WHERE model = 'naive_last') AS Lift_val_MAE,
    ((SELECT MAE_test FROM errors WHERE model = 'naive_last') - MAE_test)
      / (SELECT MAE_test FROM errors WHERE model = 'naive_last') AS Lift_test_MAE
  FROM errors
)"""


def scored_baselines(spark: SparkSession, sf: str, naive: bool = True) -> DataFrame:
    rows = split_signal(spark, sf)
    frames = [_naive_of(rows)] if naive else []
    counts = baselines.calendar_counts(rows.where("split = 'train'"))  # train rows are read once for all three
    for model, how in _MODELS.items():
        frames.append(metrics.scored_columns(baselines.calendar_forecast(rows, how, counts=counts), model, ref="steps_lag1"))
    return metrics.stack_scored(frames)


def _naive_of(rows: DataFrame) -> DataFrame:
    return metrics.scored_columns(baselines.naive_forecast(rows), "naive_last", ref="steps_lag1")


_BOARD_COLUMNS = ["MAE_train", "MAE_val", "MAE_test", "RMSE_val", "RMSE_test"]
_LIFTS = ["Lift_val_MAE", "Lift_test_MAE"]


@check(
    "leaderboard",
    f'WITH {BOARD} SELECT "rank", model, {sql_rounded(_BOARD_COLUMNS, 5)} FROM board',
)
def leaderboard_query(spark: SparkSession, sf: str) -> DataFrame:
    board = leaderboard.leaderboard(metrics.evaluate(scored_baselines(spark, sf), percentiles=()))
    return round_columns(board.select("rank", "model", *_BOARD_COLUMNS), _BOARD_COLUMNS, 5)


@check("lift_vs_naive", f"WITH {BOARD} SELECT model, {sql_rounded(_LIFTS, 5)} FROM board")
def lift_vs_naive(spark: SparkSession, sf: str) -> DataFrame:
    board = leaderboard.compare(metrics.evaluate(scored_baselines(spark, sf), percentiles=()))
    return round_columns(leaderboard.add_lift(board).select("model", *_LIFTS), _LIFTS, 5)


# ---------------------------------------------------------------- examples

_GAP = f"""WITH {MEDIAN_SCORED},
user_days AS (SELECT user_id, CAST(ts AS DATE) AS "day", count(*) AS rows FROM scored GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "day") AS i, sum(rows) OVER (PARTITION BY user_id) AS n
        FROM user_days),
spans AS (SELECT user_id, max("day") AS until_, sum(rows) AS points FROM nth WHERE i <= 14 AND n >= 10
          GROUP BY user_id HAVING sum(rows) >= 4),
placed AS (
  SELECT s.user_id, event_id, steps, yhat, points,
    row_number() OVER (PARTITION BY s.user_id ORDER BY ts, event_id) - 1 AS position,
    least(greatest(floor(points * 0.05::DOUBLE), 8), 64, points - 2) AS mid
  FROM scored s JOIN spans p ON s.user_id = p.user_id AND CAST(ts AS DATE) <= until_
),
marked AS (SELECT *, position >= floor((points - mid) / 2) AND position < floor((points - mid) / 2) + mid AS hidden FROM placed)
SELECT user_id, event_id, CAST(position AS BIGINT) AS position, steps AS true_steps, hidden,
       CASE WHEN NOT hidden THEN steps END AS observed_steps, {sql_round('CASE WHEN hidden THEN yhat END', 4)} AS filled_steps
FROM marked"""


@check("gap_example", _GAP)
def gap_example(spark: SparkSession, sf: str) -> DataFrame:
    rows = freeze(baselines.calendar_forecast(split_signal(spark, sf, lagged=False), "median"))
    table = examples.gap_example(rows)
    return table.select(
        "user_id", "event_id", "position", "true_steps", "hidden", "observed_steps",
        rounded("filled_steps", 4).alias("filled_steps"),
    )


@check(
    "gap_example_one_user",
    f"""SELECT g.* FROM ({_GAP}) g WHERE user_id = (
  SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 10 ORDER BY min((ts, event_id)) LIMIT 1 OFFSET 7)""",
)
def gap_example_one_user(spark: SparkSession, sf: str) -> DataFrame:
    rows = freeze(baselines.calendar_forecast(split_signal(spark, sf, lagged=False), "median"))
    table = examples.gap_example(rows, user_rank=7)
    return table.select(
        "user_id", "event_id", "position", "true_steps", "hidden", "observed_steps",
        rounded("filled_steps", 4).alias("filled_steps"),
    )


@check(
    "scored_sample",
    f"""WITH {MEDIAN_SCORED} SELECT event_id, steps_t AS y, {sql_round('yhat', 4)} AS yhat
FROM scored WHERE split = 'test' ORDER BY ts, event_id LIMIT 500""",
)
def scored_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = baselines.calendar_forecast(split_signal(spark, sf, lagged=False), "median").where("split = 'test'")
    return examples.first_scored(rows, 500).select("event_id", F.col("steps_t").alias("y"), rounded("yhat", 4).alias("yhat"))
