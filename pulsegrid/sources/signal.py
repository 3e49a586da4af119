"""From nested matrices or event rows to the long signal table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid.functions.calendar import (
    day_number_to_timestamp,
    null_if_nan,
    parse_number,
    parse_timestamp,
    slot_in_day,
)
from pulsegrid.operators.skew import HotKeys, join_by_key

_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
CELL_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("steps", _MATRIX),
        T.StructField("hr", _MATRIX),
        T.StructField("date_dnum", T.ArrayType(T.DoubleType())),
        T.StructField("dt_dnum", _MATRIX),
    ]
)


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    return spark.read.format(format).options(**options).load(path)


def promote_rows(cells: DataFrame) -> DataFrame:
    """Flat signals (one row of slots) to matrices with a single row."""
    out = {}
    for name in ("steps", "hr", "dt_dnum"):
        kind = cells.schema[name].dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType):
            out[name] = F.when(F.size(name) > 0, F.array(F.col(name)))
    return cells.withColumns(out) if out else cells


def explode_cells(cells: DataFrame, min_days: int = 0, promote_1d: bool = False) -> DataFrame:
    """One row per matrix position.

    Each row of the matrix becomes a record first and each slot a record second, so no array larger than a
    matrix is built; a missing heart-rate matrix gives missing values. Cells with a calendar shorter than
    ``min_days``, or without signal, times or calendar, give nothing.
    """
    if promote_1d:
        cells = promote_rows(cells)
    filled = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("steps", "dt_dnum", "date_dnum")]
    usable = cells.where(filled[0] & filled[1] & filled[2] & (F.size("date_dnum") >= min_days))
    slots = usable.select(
        "user_id", "hr", "dt_dnum", "date_dnum", F.posexplode("steps").alias("row_idx", "_steps")
    ).select(
        "user_id",
        "row_idx",
        "date_dnum",
        "_steps",
        F.get("hr", F.col("row_idx")).alias("_hr"),
        F.get("dt_dnum", F.col("row_idx")).alias("_dt"),
    )
    values = slots.select(
        "user_id", "row_idx", "date_dnum", "_hr", "_dt", F.posexplode("_steps").alias("col_idx", "_value")
    )
    pick = lambda array: F.get(array, F.col("col_idx")).cast("double")
    return values.select(
        "user_id",
        "row_idx",
        "col_idx",
        F.to_date(day_number_to_timestamp(pick("date_dnum"))).alias("date"),
        day_number_to_timestamp(pick("_dt")).alias("ts"),
        null_if_nan(F.col("_value").cast("double")).alias("steps"),
        null_if_nan(pick("_hr")).alias("hr"),
    )


def analyzer_view(signal: DataFrame) -> DataFrame:
    """Same rows under the names of the profile: ``steps_t``, ``heart_rate``."""
    return signal.withColumnsRenamed({"steps": "steps_t", "hr": "heart_rate"})


def coerce_signal(raw: DataFrame) -> DataFrame:
    """Text columns to a typed signal; what does not parse becomes missing."""
    return raw.withColumns(
        {
            "ts": parse_timestamp("ts"),
            "date": F.to_date(parse_timestamp("date")) if "date" in raw.columns else F.to_date(parse_timestamp("ts")),
            "steps": parse_number("steps"),
            "hr": parse_number("hr"),
        }
    )


def signal_from_events(events: DataFrame, hr: Column | None = None) -> DataFrame:
    """Event rows as a signal: the value is the step count, the JSON counter the heart rate.

    A counter divisible by ten stands for a missing heart rate.
    """
    counter = F.get_json_object("props", "$.k").cast("double")
    hr = F.when(counter % 10 != 0, counter) if hr is None else hr
    return events.select(
        "user_id",
        "event_id",
        "ts",
        slot_in_day("ts").alias("row_idx"),
        F.to_date("ts").alias("date"),
        null_if_nan(F.col("value")).alias("steps"),
        hr.alias("hr"),
    )


def add_day_index(signal: DataFrame, key: str = "user_id", hot: HotKeys | None = None) -> DataFrame:
    """Days since the first day of the series, from one row per series."""
    first = signal.groupBy(key).agg(F.min("date").alias("_first_day"))
    joined = join_by_key(signal, first, key, "left", hot)
    return joined.withColumn("col_idx", F.datediff("date", "_first_day").cast("int")).drop("_first_day")
