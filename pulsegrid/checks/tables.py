"""Queries: sources, features, splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.checks.common import (
    SIGNAL,
    check,
    day_text,
    round_columns,
    rounded,
    signal,
    sql_round,
    sql_rounded,
    table,
)
from pulsegrid.functions import calendar as C, weights as W
from pulsegrid.layout import Layout, layout_of
from pulsegrid.operators import encode, examples, filters, folds, profile, series, splits
from pulsegrid.plans.features import FeatureSettings, build_features
from pulsegrid.plans.train import RunSettings, chosen_inputs
from pulsegrid.sources import signal as source

W_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
LAGS = series.DEFAULT_LAGS
WINDOWS = series.DEFAULT_WINDOWS
ID = ["user_id", "event_id"]


def _lag_sql(column: str, lags=LAGS) -> str:
    return ", ".join(f"lag({column}, {n}) OVER w AS {column}_lag{n}" for n in lags)


def _roll_names(column: str, statistics=("mean", "std"), windows=WINDOWS) -> list[str]:
    return [f"{column}_{s}_{n}" for n in windows for s in statistics]


_SQL_STATISTIC = {"mean": "avg", "std": "stddev_samp", "max": "max"}


def _roll_sql(column: str, past_only: bool, statistics=("mean", "std"), windows=WINDOWS) -> str:
    out = []
    for n in windows:
        frame = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if past_only else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        for s in statistics:
            out.append(f"{_SQL_STATISTIC[s]}({column}) OVER ({W_ORDER} {frame}) AS {column}_{s}_{n}")
    return ", ".join(out)


# ---------------------------------------------------------------- sources


@check(
    "signal_adapter",
    f"""WITH {SIGNAL}
SELECT user_id, event_id, row_idx,
       CAST("date" - min("date") OVER (PARTITION BY user_id) AS INTEGER) AS col_idx,
       strftime("date", '%Y-%m-%d') AS "date", steps, hr
FROM sig""",
)
def signal_adapter(spark: SparkSession, sf: str) -> DataFrame:
    rows = source.add_day_index(signal(spark, sf))
    return rows.select(*ID, "row_idx", "col_idx", day_text("date").alias("date"), "steps", "hr")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 64 as 8 x 8 matrices: every fifth user has a short calendar, every seventh no heart rate."""
    vectors = table(spark, sf, "embeddings")
    user = F.col("vec_id")
    row = lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), lambda x: x.cast("double"))
    rows = F.sequence(F.lit(0), F.lit(7))
    days = F.when(user % 5 == 0, 4).otherwise(8)
    return vectors.select(
        user.alias("user_id"),
        F.transform(rows, row).alias("steps"),
        F.when(user % 7 != 0, F.transform(rows, lambda r: F.transform(row(r), lambda x: x * 100))).alias("hr"),
        F.transform(F.sequence(F.lit(1), days), lambda c: F.lit(739252.0) + c).alias("date_dnum"),
        F.transform(
            rows, lambda r: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda c: F.lit(739252.0) + c + r / F.lit(96.0))
        ).alias("dt_dnum"),
    )


@check(
    "matrix_explode",
    """SELECT vec_id AS user_id, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx,
       strftime(DATE '2024-01-02' + CAST(c AS INTEGER), '%Y-%m-%d') AS "date",
       CAST(epoch_us(make_timestamp(CAST(round((739253 + c + r / 96.0::DOUBLE - 719529) * 86400000000) AS BIGINT)))
            AS BIGINT) AS ts_micros,
       CAST(embedding[r * 8 + c + 1] AS DOUBLE) AS steps,
       CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[r * 8 + c + 1] AS DOUBLE) * 100 END AS hr
FROM embeddings, range(8) AS rows_(r), range(8) AS cols_(c)
WHERE vec_id % 5 <> 0""",
)
def matrix_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = source.explode_cells(_cells(spark, sf), min_days=8)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(
        "user_id", "row_idx", "col_idx", day_text("date").alias("date"), micros.alias("ts_micros"), "steps", "hr"
    )


@check(
    "matrix_explode_flat",
    """SELECT vec_id AS user_id, 0 AS row_idx, CAST(c AS INTEGER) AS col_idx,
       strftime(DATE '2024-01-02' + CAST(c AS INTEGER), '%Y-%m-%d') AS "date",
       CAST(embedding[c + 1] AS DOUBLE) AS steps_t, CAST(NULL AS DOUBLE) AS heart_rate
FROM embeddings, range(64) AS cols_(c)""",
)
def matrix_explode_flat(spark: SparkSession, sf: str) -> DataFrame:
    days = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda c: F.lit(739252.0) + c)
    cells = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("user_id"),
        F.col("embedding").cast("array<double>").alias("steps"),
        F.lit(None).cast("array<double>").alias("hr"),
        days.alias("date_dnum"),
        days.alias("dt_dnum"),
    )
    rows = source.analyzer_view(source.explode_cells(cells, promote_1d=True))
    return rows.select("user_id", "row_idx", "col_idx", day_text("date").alias("date"), "steps_t", "heart_rate")


@check(
    "datenum_to_ts",
    """SELECT o_orderkey, CAST(epoch_us(make_timestamp(CAST(round((x - 719529) * 86400000000) AS BIGINT))) AS BIGINT)
       AS ts_micros
FROM (SELECT o_orderkey, 719529 + date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))
             + (o_orderkey % 96) / 96.0::DOUBLE AS x FROM orders)""",
)
def datenum_to_ts(spark: SparkSession, sf: str) -> DataFrame:
    number = F.lit(719529) + F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")) + (F.col("o_orderkey") % 96) / F.lit(96.0)
    ts = C.day_number_to_timestamp(number)
    return table(spark, sf, "orders").select("o_orderkey", F.unix_micros(ts.cast("timestamp")).alias("ts_micros"))


@check(
    "coerced_text",
    """SELECT event_id,
       CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
       CASE WHEN event_id % 4 <> 0 THEN value END AS steps
FROM events""",
)
def coerced_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, text).otherwise("no time").alias("ts"),
        F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string")).otherwise("n/a").alias("steps"),
        F.lit("NaN").alias("hr"),
    )
    typed = source.coerce_signal(raw)
    return typed.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "steps")


# ---------------------------------------------------------------- filters


@check(
    "min_days_users",
    f"""WITH {SIGNAL}
SELECT user_id, event_id FROM sig
WHERE user_id IN (SELECT user_id FROM sig GROUP BY user_id HAVING count(DISTINCT "date") >= 25)""",
)
def min_days_users(spark: SparkSession, sf: str) -> DataFrame:
    return filters.min_days(signal(spark, sf), 25).select(*ID)


@check(
    "min_samples_users",
    """SELECT user_id, event_id FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 65)""",
)
def min_samples_users(spark: SparkSession, sf: str) -> DataFrame:
    return filters.min_samples(signal(spark, sf), 65).select(*ID)


@check("rows_per_user", "SELECT user_id, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY user_id")
def rows_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return filters.series_rows(signal(spark, sf))


HALF_DAYS = """
grid AS (
  SELECT user_id, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') AS ts, sum(value) AS steps
  FROM events GROUP BY ALL
),
gaps AS (
  SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 60000000.0::DOUBLE AS gap
  FROM grid
)"""


def _half_days(spark: SparkSession, sf: str) -> DataFrame:
    half = F.when(F.hour("ts") < 12, F.to_date("ts").cast("timestamp_ntz")).otherwise(
        F.timestamp_add("HOUR", F.lit(12), F.to_date("ts").cast("timestamp_ntz"))
    )
    return signal(spark, sf).groupBy("user_id", half.alias("ts")).agg(F.sum("steps").alias("steps"))


@check(
    "strict_cadence",
    f"""WITH {HALF_DAYS}
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS ts_micros, {sql_round('steps')} AS steps, gap AS delta_minutes_from_prev
FROM gaps WHERE gap IS NULL OR gap = 720""",
)
def strict_cadence(spark: SparkSession, sf: str) -> DataFrame:
    grid = series.add_gap_minutes(_half_days(spark, sf), Layout(tie=()))
    kept = filters.strict_cadence(grid, 720)
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros")
    return kept.select("user_id", micros, rounded("steps").alias("steps"), "delta_minutes_from_prev")


# ---------------------------------------------------------------- columns per row


@check(
    "slot_and_day",
    """SELECT event_id, CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER) AS slot_in_day,
       CAST(floor((hour(ts) * 60 + minute(ts)) / 22.5) AS INTEGER) AS slot_wide, strftime(ts, '%Y-%m-%d') AS "day"
FROM events""",
)
def slot_and_day(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).select(
        "event_id",
        C.slot_in_day().alias("slot_in_day"),
        C.slot_in_day(slot_minutes=22.5).alias("slot_wide"),
        day_text(C.day_of()).alias("day"),
    )


@check(
    "calendar_fields",
    """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS "hour",
       CAST(month(ts) AS INTEGER) AS "month"
FROM events""",
)
def calendar_fields(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).withColumns(C.calendar_fields(C.CALENDAR_FIELDS)).select("event_id", *C.CALENDAR_FIELDS)


@check(
    "sample_weights",
    f"""SELECT event_id,
  {sql_round("CASE WHEN value BETWEEN 80 AND 400 THEN 1 + 0.5 * (value - 80) / 320 ELSE 1 END")} AS band,
  {sql_round("1 + least(abs(value) / 200, 3)")} AS peak,
  {sql_round("1 + least(power(abs(value) / 150, 1.3), 5)")} AS peak_bent,
  CASE WHEN value >= 50 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS active
FROM events""",
)
def sample_weights(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("steps")
    return signal(spark, sf).select(
        "event_id",
        rounded(W.band_weight(y, 80, 400, 1.5)).alias("band"),
        rounded(W.power_weight(y, 200, 1.0, 3.0)).alias("peak"),
        rounded(W.power_weight(y, 150, 1.3, 5.0)).alias("peak_bent"),
        W.active_weight(y, 50, 3.0).alias("active"),
    )


@check(
    "log1p_target",
    f"""SELECT event_id, {sql_round("ln(1 + greatest(value - 20, 0))")} AS z,
       {sql_round("greatest(exp(ln(1 + greatest(value - 20, 0))) - 1, 0)")} AS back,
       {sql_round("greatest(exp((value - 50) / 100) - 1, 0)")} AS inverse
FROM events""",
)
def log1p_target(spark: SparkSession, sf: str) -> DataFrame:
    z = W.log1p_clipped(F.col("steps") - 20)
    return signal(spark, sf).select(
        "event_id",
        rounded(z).alias("z"),
        rounded(W.expm1_clipped(z)).alias("back"),
        rounded(W.expm1_clipped((F.col("steps") - 50) / 100)).alias("inverse"),
    )


@check(
    "filled_features",
    f"""WITH {SIGNAL}
SELECT event_id, coalesce(hr, 0) AS hr_zero,
       {sql_round("coalesce(hr, avg(hr) OVER ())")} AS hr_mean,
       {sql_round("coalesce(hr, 0) / stddev_samp(coalesce(hr, 0)) OVER ()")} AS hr_scaled
FROM sig""",
)
def filled_features(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = signal(spark, sf).select("event_id", "hr", F.col("hr").alias("hr_zero"), F.col("hr").alias("hr_mean"))
    rows = encode.impute_mean(encode.fill_missing(rows, ["hr_zero"]), ["hr_mean"])
    rows = VectorAssembler(inputCols=["hr_zero"], outputCol="features").transform(rows)
    scaled = encode.std_scaler().fit(rows).transform(rows)
    return scaled.select(
        "event_id",
        "hr_zero",
        rounded("hr_mean").alias("hr_mean"),
        rounded(vector_to_array("scaled")[0]).alias("hr_scaled"),
    )


@check(
    "onehot_events",
    """SELECT event_id, event_type, CAST(event_type = 'error' AS TINYINT) AS event_type_error,
       CAST(event_type = 'purchase' AS TINYINT) AS event_type_purchase,
       CAST(event_type = 'signup' AS TINYINT) AS event_type_signup,
       CAST(event_type = 'view' AS TINYINT) AS event_type_view
FROM events""",
)
def onehot_events(spark: SparkSession, sf: str) -> DataFrame:
    return encode.one_hot(table(spark, sf, "events").select("event_id", "event_type"), "event_type")


@check(
    "onehot_users",
    """WITH ranked AS (SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) AS INTEGER) AS r FROM events),
users AS (SELECT user_id, r, max(r) OVER () AS n FROM ranked)
SELECT user_id, CAST(n - 1 AS INTEGER) AS size, CAST(CASE WHEN r > 1 THEN n - r END AS INTEGER) AS active,
       CAST(count(*) AS BIGINT) AS rows
FROM users GROUP BY ALL""",
)
def onehot_users(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse form: length of the vector and position of its single one; the first user has none."""
    rows = encode.one_hot_vector(signal(spark, sf).select("user_id"))
    # The vector as it is stored: a row costs what its entries cost, not what the number of users does.
    stored = F.unwrap_udt("user_id_vec")
    position = F.array_position(stored["values"], F.lit(1.0))
    return rows.groupBy(
        "user_id",
        stored["size"].alias("size"),
        F.when(position > 0, F.element_at(stored["indices"], position.cast("int"))).alias("active"),
    ).agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- windows


@check(
    "gap_minutes",
    f"""SELECT event_id, {sql_round("(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0::DOUBLE")}
       AS delta_minutes_from_prev
FROM events WINDOW w AS ({W_ORDER})""",
)
def gap_minutes(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.add_gap_minutes(signal(spark, sf))
    return rows.select("event_id", rounded("delta_minutes_from_prev").alias("delta_minutes_from_prev"))


@check(
    "lags",
    f"""WITH {SIGNAL} SELECT event_id, {_lag_sql('steps')}, {_lag_sql('hr')} FROM sig WINDOW w AS ({W_ORDER})""",
)
def lags(spark: SparkSession, sf: str) -> DataFrame:
    both = series.lag_columns("steps") + series.lag_columns("hr")
    rows = series.add_series_columns(signal(spark, sf), both)
    return rows.select("event_id", *[f"{c}_lag{n}" for c in ("steps", "hr") for n in LAGS])


_ROLLED = _roll_names("steps") + _roll_names("hr")


@check(
    "rolling_incl",
    f"""WITH {SIGNAL}, rolled AS (SELECT event_id, {_roll_sql('steps', False)}, {_roll_sql('hr', False)} FROM sig)
SELECT event_id, {sql_rounded(_ROLLED)} FROM rolled""",
)
def rolling_incl(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.make_rolls(signal(spark, sf))
    return round_columns(rows.select("event_id", *_ROLLED), _ROLLED)


@check(
    "rolling_past_only",
    f"""WITH {SIGNAL}, rolled AS (SELECT event_id, {_roll_sql('steps', True)}, {_roll_sql('hr', True)} FROM sig)
SELECT event_id, {sql_rounded(_ROLLED)} FROM rolled""",
)
def rolling_past_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.make_rolls(signal(spark, sf), past_only=True)
    return round_columns(rows.select("event_id", *_ROLLED), _ROLLED)


_DYNAMICS = ["hr_delta1", *_roll_names("hr", ("max", "std"))]


@check(
    "hr_dynamics",
    f"""WITH {SIGNAL}, rolled AS (
  SELECT event_id, hr - lag(hr) OVER w AS hr_delta1, {_roll_sql('hr', True, ('max', 'std'))} FROM sig WINDOW w AS ({W_ORDER})
) SELECT event_id, {sql_rounded(_DYNAMICS)} FROM rolled""",
)
def hr_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.add_hr_dynamics(signal(spark, sf))
    return round_columns(rows.select("event_id", *_DYNAMICS), _DYNAMICS)


@check(
    "target_interval",
    f"""SELECT event_id, value AS steps_t0, lead(value, 1) OVER w AS steps_t1, lead(value, 4) OVER w AS steps_t4
FROM events WINDOW w AS ({W_ORDER})""",
)
def target_interval(spark: SparkSession, sf: str) -> DataFrame:
    targets = [series.target_column("steps", h, f"steps_t{h}") for h in (0, 1, 4)]
    rows = series.add_series_columns(signal(spark, sf), series.combine(targets))
    return rows.select("event_id", "steps_t0", "steps_t1", "steps_t4")


DAILY = f"""WITH {SIGNAL}, days AS (
  SELECT user_id, "date" AS "day", coalesce(sum(steps), 0) AS steps, avg(hr) AS hr FROM sig GROUP BY ALL
), targets AS (SELECT *, lead(steps) OVER (PARTITION BY user_id ORDER BY "day") AS steps_t FROM days)
SELECT user_id, strftime("day", '%Y-%m-%d') AS "day", {sql_rounded(['steps', 'hr', 'steps_t'])} FROM targets"""


@check("target_daily_total", DAILY)
def target_daily_total(spark: SparkSession, sf: str) -> DataFrame:
    days = series.daily_totals(signal(spark, sf))
    days = round_columns(days, ["steps", "hr", "steps_t"])
    return days.select("user_id", day_text("day").alias("day"), "steps", "hr", "steps_t")


@check("features_daily", DAILY + " WHERE steps_t IS NOT NULL")
def features_daily(spark: SparkSession, sf: str) -> DataFrame:
    days = build_features(signal(spark, sf), FeatureSettings(task="daily_total", user_id_encoding="drop"))
    days = round_columns(days, ["steps", "hr", "steps_t"])
    return days.select("user_id", day_text("day").alias("day"), "steps", "hr", "steps_t")


_BASE_FEATURES = """
  SELECT *, lead(steps, 1) OVER w AS steps_t,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0::DOUBLE AS delta_minutes_from_prev
  FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_FEATURE_IDS = """event_id, row_idx AS slot_in_day, CAST(isodow(ts) - 1 AS INTEGER) AS dow,
  CAST(hour(ts) AS INTEGER) AS "hour", CAST(month(ts) AS INTEGER) AS "month", steps_t"""
_FEATURE_ID_NAMES = ["event_id", "slot_in_day", "dow", "hour", "month", "steps_t"]


def _features_sql(columns: str, lagged: list[str], measured: list[str]) -> str:
    plain = ", ".join(f'"{c}"' for c in [*_FEATURE_ID_NAMES, *lagged])
    return f"""WITH {SIGNAL}, based AS ({_BASE_FEATURES}), kept AS (SELECT * FROM based WHERE steps_t IS NOT NULL),
features AS (
  SELECT {_FEATURE_IDS}, delta_minutes_from_prev, lag(steps) OVER w AS ref_prev, {columns}
  FROM kept WINDOW w AS ({W_ORDER})
) SELECT {plain}, ref_prev, {sql_rounded(['delta_minutes_from_prev', *measured])} FROM features"""


_HR_LAGS = [f"hr_lag{n}" for n in LAGS]
_STRICT = ["hr_delta1", *_roll_names("hr", ("max", "mean", "std"))]


@check(
    "features_strict",
    _features_sql(
        f"{_lag_sql('hr')}, hr - lag(hr) OVER w AS hr_delta1, {_roll_sql('hr', True, ('max', 'mean', 'std'))}",
        _HR_LAGS,
        _STRICT,
    ),
)
def features_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_features(signal(spark, sf), FeatureSettings(user_id_encoding="drop"))
    names = ["delta_minutes_from_prev", *_STRICT]
    return round_columns(rows.select(*_FEATURE_ID_NAMES, *_HR_LAGS, "ref_prev", *names), names)


_ALL_LAGS = [f"{c}_lag{n}" for c in ("steps", "hr") for n in LAGS]


@check(
    "features_with_steps",
    _features_sql(
        f"{_lag_sql('steps')}, {_lag_sql('hr')}, {_roll_sql('steps', False)}, {_roll_sql('hr', False)}",
        _ALL_LAGS,
        _ROLLED,
    ),
)
def features_with_steps(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_features(signal(spark, sf), FeatureSettings(allow_step_inputs=True, user_id_encoding="drop"))
    names = ["delta_minutes_from_prev", *_ROLLED]
    return round_columns(rows.select(*_FEATURE_ID_NAMES, *_ALL_LAGS, "ref_prev", *names), names)


# Inputs that models take: all numeric columns but target, current value, previous value and event number.
_INPUTS = ["user_id", "row_idx", "hr", "slot_in_day", "dow", "hour", "month", *_HR_LAGS, "delta_minutes_from_prev", *_STRICT]
_DAILY_INPUTS = ["user_id", "hr"]
_STRICT_SQL = _features_sql(
    f"user_id, row_idx, hr, {_lag_sql('hr')}, hr - lag(hr) OVER w AS hr_delta1, {_roll_sql('hr', True, ('max', 'mean', 'std'))}",
    ["user_id", "row_idx", "hr", *_HR_LAGS],
    _STRICT,
)


def _known_sql(layout: str, names: list[str], rows: str) -> str:
    counts = ", ".join(f'count("{n}") AS "{n}"' for n in names)
    return f"SELECT '{layout}' AS layout, name, known FROM (UNPIVOT (SELECT {counts} FROM ({rows})) ON * INTO NAME name VALUE known)"


@check(
    "chosen_inputs",
    f"{_known_sql('events', _INPUTS, _STRICT_SQL)} UNION ALL "
    f"{_known_sql('days', _DAILY_INPUTS, DAILY + ' WHERE steps_t IS NOT NULL')}",
)
def chosen_inputs_query(spark: SparkSession, sf: str) -> DataFrame:
    """The list of inputs of event and daily features, with how many rows know each."""
    parts = []
    for layout, settings in (("events", FeatureSettings(user_id_encoding="drop")), ("days", FeatureSettings(task="daily_total", user_id_encoding="drop"))):
        rows = build_features(signal(spark, sf), settings)
        names = chosen_inputs(rows, RunSettings("inputs"), layout_of(rows.columns))
        known = rows.agg(*[F.count(n).alias(n) for n in names])
        listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("known")) for n in names])
        parts.append(known.select(F.lit(layout).alias("layout"), F.inline(listed)))
    return parts[0].unionByName(parts[1])


_GRID_FEATURES = f"""WITH {HALF_DAYS}, kept AS (
  SELECT *, lead(steps) OVER (PARTITION BY user_id ORDER BY ts) AS steps_t FROM gaps WHERE gap IS NULL OR gap = 720
), full_ AS (SELECT * FROM kept WHERE steps_t IS NOT NULL),
features AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS ts_micros, steps_t,
  lag(steps, 1) OVER w AS steps_lag1, lag(steps, 2) OVER w AS steps_lag2,
  avg(steps) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS steps_mean_4
  FROM full_ WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts_micros, {sql_rounded(['steps_t', 'steps_lag1', 'steps_lag2', 'steps_mean_4'])} FROM features"""


@check("features_cadence", _GRID_FEATURES)
def features_cadence(spark: SparkSession, sf: str) -> DataFrame:
    """The cadence filter comes before target, lags and windows; gaps are those before the filter."""
    settings = FeatureSettings(
        user_id_encoding="drop",
        allow_step_inputs=True, use_hr=False, lags=(1, 2), roll_windows=(4,), strict_step_minutes=720, gap=False
    )
    rows = build_features(_half_days(spark, sf), settings, Layout(tie=()))
    names = ["steps_t", "steps_lag1", "steps_lag2", "steps_mean_4"]
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros")
    return round_columns(rows.select("user_id", micros, *names), names)


# ---------------------------------------------------------------- splits


@check(
    "split_global",
    """SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-20 23:59:59' THEN 'train'
  WHEN ts <= TIMESTAMP '2024-01-25 23:59:59' THEN 'val' ELSE 'test' END AS split FROM events""",
)
def split_global(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split(
        signal(spark, sf), "global_time", train_until="2024-01-20 23:59:59", valid_until="2024-01-25 23:59:59"
    )
    return rows.select("event_id", "split")


RANKED_DAYS = """
days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS "day" FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "day" DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n
  FROM days
)"""


@check(
    "split_last_days",
    f"""WITH {RANKED_DAYS}
SELECT event_id, e.user_id, CASE WHEN n <= 25 THEN 'train' WHEN r <= 12 THEN 'test' WHEN r <= 25 THEN 'val'
       ELSE 'train' END AS split
FROM events e JOIN ranked d ON e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day""",
)
def split_last_days(spark: SparkSession, sf: str) -> DataFrame:
    """Some users have 25 days or fewer and stay in train."""
    rows = splits.split(signal(spark, sf), "per_user", val_days=13, test_days=12)
    return rows.select("event_id", "user_id", "split")


# Day counts per user for the shares 0.15 and 0.15, as in the split by share.
SHARE_SPLIT = f"""{RANKED_DAYS},
counts AS (
  SELECT *, greatest(CAST(floor(n * 0.15::DOUBLE) AS BIGINT), 1) AS want_val,
         greatest(CAST(floor(n * 0.15::DOUBLE) AS BIGINT), 1) AS want_test FROM ranked
),
parts AS (
  SELECT user_id, "day", CASE WHEN n < 10 THEN 'train' WHEN r <= want_test THEN 'test'
         WHEN r <= want_test + want_val THEN 'val' ELSE 'train' END AS split FROM counts
)"""


@check(
    "split_pct",
    f"""WITH {SHARE_SPLIT}
SELECT event_id, e.user_id, split FROM events e JOIN parts d ON e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day""",
)
def split_pct(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split(signal(spark, sf), "per_user_pct").select("event_id", "user_id", "split")


@check(
    "split_pct_overflow",
    f"""WITH {RANKED_DAYS},
counts AS (SELECT *, greatest(CAST(floor(n * 0.4::DOUBLE) AS BIGINT), 20) AS v,
                  greatest(CAST(floor(n * 0.3::DOUBLE) AS BIGINT), 8) AS t FROM ranked),
cut AS (SELECT *, greatest(0, v + t - (n - 1)) AS over_ FROM counts),
cut2 AS (SELECT *, v - least(v, over_) AS v2, t - least(t, over_ - least(v, over_)) AS t2 FROM cut),
parts AS (SELECT user_id, "day", CASE WHEN n < 22 THEN 'train' WHEN r <= t2 THEN 'test' WHEN r <= t2 + v2 THEN 'val'
                 ELSE 'train' END AS split FROM cut2)
SELECT event_id, split FROM events e JOIN parts d ON e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day""",
)
def split_pct_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """Minima so large that they must give way to one train day."""
    rows = splits.split_share_of_days(signal(spark, sf), 0.4, 0.3, 22, 20, 8)
    return rows.select("event_id", "split")


@check(
    "split_counts",
    f"""WITH {SHARE_SPLIT}
SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT e.user_id) AS BIGINT) AS users
FROM events e JOIN parts d ON e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day GROUP BY split""",
)
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_counts(splits.split(signal(spark, sf), "per_user_pct"))


@check(
    "holdout_days",
    """WITH listed AS (SELECT user_id, max(CAST(ts AS DATE)) AS "day" FROM events GROUP BY user_id)
SELECT event_id, CASE WHEN CAST(e.ts AS DATE) = l.day THEN 'inside' ELSE 'outside' END AS side
FROM events e JOIN listed l ON e.user_id = l.user_id""",
)
def holdout_days(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on and off the last day of each user, by an explicit day table."""
    rows = signal(spark, sf)
    listed = rows.groupBy("user_id").agg(F.max(F.to_date("ts")).alias("day"))
    inside = filters.on_days(rows, listed).select("event_id", F.lit("inside").alias("side"))
    outside = filters.on_days(rows, listed, inside=False).select("event_id", F.lit("outside").alias("side"))
    return inside.unionByName(outside)


@check(
    "row_index",
    "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id, user_id) - 1 AS BIGINT) AS row_index FROM events",
)
def row_index(spark: SparkSession, sf: str) -> DataFrame:
    return folds.time_index(signal(spark, sf).select("user_id", "event_id", "ts")).select("event_id", "row_index")


@check(
    "time_folds",
    """WITH indexed AS (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id, user_id) - 1 AS i, count(*) OVER () AS n FROM events
)
SELECT event_id, CAST(i AS BIGINT) AS row_index,
       CAST(CASE WHEN i < n - 5 * (n // 6) THEN -1 ELSE (i - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS fold
FROM indexed""",
)
def time_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.assign_folds(signal(spark, sf).select("user_id", "event_id", "ts"), 5)
    return rows.select("event_id", "row_index", "fold")


# ---------------------------------------------------------------- profile


@check(
    "profile_per_user",
    f"""SELECT user_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days,
  min(ts) AS first_ts, max(ts) AS last_ts, {sql_round('avg(value)')} AS mean_steps,
  {sql_round('median(value)')} AS median_steps,
  {sql_round('avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_frac,
  {sql_round('count(*) / count(DISTINCT CAST(ts AS DATE))')} AS rows_per_day,
  CAST(count(*) // 24 AS INTEGER) AS days_complete_approx
FROM events GROUP BY user_id""",
)
def profile_per_user(spark: SparkSession, sf: str) -> DataFrame:
    users = profile.per_user_table(signal(spark, sf), slot_minutes=60)
    return round_columns(users, ["mean_steps", "median_steps", "zero_frac", "rows_per_day"])


@check(
    "profile_user_day",
    """SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS "date", CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) >= 4 AS INTEGER) AS complete
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
)
def profile_user_day(spark: SparkSession, sf: str) -> DataFrame:
    days = profile.user_day_table(signal(spark, sf), slot_minutes=360)
    return days.withColumn("date", day_text("date"))


@check(
    "profile_hour_of_day",
    f"""SELECT CAST(hour(ts) AS INTEGER) AS "hour", CAST(count(value) AS BIGINT) AS "count",
  {sql_round('avg(value)')} AS "mean", {sql_round('median(value)')} AS "median", {sql_round('stddev_samp(value)')} AS "std"
FROM events GROUP BY 1""",
)
def profile_hour_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.hour_of_day_table(signal(spark, sf)), ["mean", "median", "std"])


@check(
    "profile_prior",
    f"""SELECT user_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS "hour",
  {sql_round('avg(value)')} AS prior_usr_dow_hour
FROM events GROUP BY ALL""",
)
def profile_prior(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.prior_table(signal(spark, sf)), ["prior_usr_dow_hour"])


_SUMMARY_ROW = f"""WITH {SIGNAL},
days AS (SELECT user_id, "date", count(*) AS rows FROM sig GROUP BY ALL),
facts AS (
  SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, min(ts) AS date_start, max(ts) AS date_end,
         avg(CASE WHEN steps >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS active_fraction,
         count(hr) / count(*) AS hr_coverage
  FROM sig),
done AS (SELECT avg(CASE WHEN rows >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS complete FROM days)"""


@check(
    "profile_summary",
    f"""{_SUMMARY_ROW},
wide AS (
  SELECT CAST(n_rows AS VARCHAR) AS n_rows, CAST(n_users AS VARCHAR) AS n_users,
    strftime(date_start, '%Y-%m-%d %H:%M') AS date_start, strftime(date_end, '%Y-%m-%d %H:%M') AS date_end,
    '4' AS slots_per_day_expected, CAST(50000 AS VARCHAR) AS active_threshold,
    CAST(CAST(round(active_fraction * 1000000) AS BIGINT) AS VARCHAR) AS active_fraction,
    CAST(CAST(round(complete * 1000000) AS BIGINT) AS VARCHAR) AS per_day_complete_fraction,
    'true' AS hr_col_present,
    CAST(CAST(round(hr_coverage * 1000000) AS BIGINT) AS VARCHAR) AS hr_coverage
  FROM facts, done)
UNPIVOT wide ON COLUMNS(*) INTO NAME "key" VALUE "value\"""".replace('\\"', '"'),
)
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    row = profile.summary_row(signal(spark, sf), slot_minutes=360)
    scaled = {n: F.round(F.col(n) * 1000000).cast("bigint") for n in ("active_fraction", "per_day_complete_fraction", "hr_coverage")}
    scaled["active_threshold"] = (F.col("active_threshold") * 1000).cast("bigint")
    scaled |= {n: F.date_format(n, "yyyy-MM-dd HH:mm") for n in ("date_start", "date_end")}
    return profile.key_value(row.withColumns(scaled))


@check(
    "dataset_sample",
    f"""WITH {SIGNAL} SELECT user_id, event_id, row_idx, steps, hr FROM sig ORDER BY user_id, ts, event_id LIMIT 5000""",
)
def dataset_sample(spark: SparkSession, sf: str) -> DataFrame:
    return profile.head_rows(signal(spark, sf), 5000).select("user_id", "event_id", "row_idx", "steps", "hr")
