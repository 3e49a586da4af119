"""Lags, rolling statistics, gaps and targets per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pulsegrid.functions.calendar import minutes_between
from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.skew import HotKeys, SeriesColumns, add_series_columns

# Default feature settings.
DEFAULT_LAGS = (1, 2, 3, 4, 8, 16, 32, 64)
DEFAULT_WINDOWS = (4, 16, 64)

_STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max}


def lag_columns(column: str, lags: Sequence[int] = DEFAULT_LAGS) -> SeriesColumns:
    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"{column}_lag{n}": F.lag(column, n).over(w) for n in lags}

    return SeriesColumns(build, back=max(lags, default=0))


def rolling_columns(
    column: str,
    windows: Sequence[int] = DEFAULT_WINDOWS,
    past_only: bool = False,
    statistics: Sequence[str] = ("mean", "std"),
) -> SeriesColumns:
    """Statistics over the last ``n`` rows, with the current row or strictly before it.

    A missing value takes a place in the window and is skipped in the statistic; a standard deviation of
    fewer than two values is missing.
    """

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for n in windows:
            frame = w.rowsBetween(-n, -1) if past_only else w.rowsBetween(-(n - 1), 0)
            for s in statistics:
                out[f"{column}_{s}_{n}"] = _STATISTICS[s](column).over(frame)
        return out

    return SeriesColumns(build, back=max(windows, default=0))


def hr_dynamics_columns(
    windows: Sequence[int] = DEFAULT_WINDOWS, column: str = "hr", delta: bool = True
) -> SeriesColumns:
    """Change against the previous row, past-only maximum and standard deviation."""
    rolled = rolling_columns(column, windows, past_only=True, statistics=("max", "std"))

    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"{column}_delta1": F.col(column) - F.lag(column, 1).over(w)}

    return SeriesColumns(build, back=1) + rolled if delta else rolled


def gap_column(layout: Layout = DEFAULT_LAYOUT, name: str = "delta_minutes_from_prev") -> SeriesColumns:
    def build(w: WindowSpec) -> dict[str, Column]:
        return {name: minutes_between(F.lag(layout.ts, 1).over(w), F.col(layout.ts))}

    return SeriesColumns(build, back=1)


def target_column(column: str = "steps", horizon: int = 1, name: str = "steps_t") -> SeriesColumns:
    """Value ``horizon`` rows ahead; 0 is the current row."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {name: F.lead(column, horizon).over(w) if horizon else F.col(column)}

    return SeriesColumns(build, ahead=horizon)


def previous_column(column: str = "steps", name: str = "ref_prev") -> SeriesColumns:
    """Reference for directional accuracy and the naive forecast, kept apart from the features."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {name: F.lag(column, 1).over(w)}

    return SeriesColumns(build, back=1)


def make_lags(
    df: DataFrame,
    column: str = "steps",
    lags: Sequence[int] = DEFAULT_LAGS,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    return add_series_columns(df, lag_columns(column, lags), layout, hot)


def make_rolls(
    df: DataFrame,
    columns: Sequence[str] = ("steps", "hr"),
    windows: Sequence[int] = DEFAULT_WINDOWS,
    past_only: bool = False,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Columns that the table does not have are passed over."""
    specs = [rolling_columns(c, windows, past_only) for c in columns if c in df.columns]
    return add_series_columns(df, combine(specs), layout, hot) if specs else df


def add_hr_dynamics(
    df: DataFrame,
    windows: Sequence[int] = DEFAULT_WINDOWS,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    return add_series_columns(df, hr_dynamics_columns(windows), layout, hot)


def add_gap_minutes(
    df: DataFrame, layout: Layout = DEFAULT_LAYOUT, hot: HotKeys | None = None
) -> DataFrame:
    return add_series_columns(df, gap_column(layout), layout, hot)


def add_interval_target(
    df: DataFrame, horizon: int = 1, layout: Layout = DEFAULT_LAYOUT, hot: HotKeys | None = None
) -> DataFrame:
    if horizon == 0:
        return df.withColumn("steps_t", F.col("steps"))
    return add_series_columns(df, target_column("steps", horizon), layout, hot)


def combine(specs: Sequence[SeriesColumns]) -> SeriesColumns:
    total = specs[0]
    for spec in specs[1:]:
        total = total + spec
    return total


def daily_totals(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Per series and day: total steps, mean heart rate, next observed day's total.

    The window runs over days, not rows, so its size is bounded by the calendar.
    """
    days = df.groupBy(layout.key, F.to_date(layout.ts).alias("day")).agg(
        F.coalesce(F.sum("steps"), F.lit(0.0)).alias("steps"), F.avg("hr").alias("hr")
    )
    by_day = Window.partitionBy(layout.key).orderBy("day")
    return days.withColumn("steps_t", F.lead("steps", 1).over(by_day))
