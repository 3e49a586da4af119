"""Feature job: signal in, model-ready table out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.calendar import CALENDAR_FIELDS, calendar_fields, day_of, slot_in_day
from pulsegrid.layout import DAILY_LAYOUT, Layout, layout_of
from pulsegrid.operators import series as S
from pulsegrid.operators.encode import one_hot, one_hot_vector
from pulsegrid.operators.filters import known_target, strict_cadence
from pulsegrid.operators.skew import (
    DividedSeries,
    HotKeys,
    SeriesColumns,
    add_series_columns,
    find_hot_keys,
    no_hot_keys,
)


@dataclass(frozen=True)
class FeatureSettings:
    task: str = "interval"  # or "daily_total"
    horizon: int = 1
    use_hr: bool = True
    allow_step_inputs: bool = False
    lags: tuple[int, ...] = S.DEFAULT_LAGS
    roll_windows: tuple[int, ...] = S.DEFAULT_WINDOWS
    calendar: tuple[str, ...] = CALENDAR_FIELDS
    user_id_encoding: str = "vector"  # one sparse column; "onehot": one column per series, "drop": none
    slot_and_day: bool = True
    gap: bool = True
    strict_step_minutes: float | None = None
    slot_minutes: float = 15


def daily_layout(layout: Layout) -> Layout:
    return replace(DAILY_LAYOUT, key=layout.key)


def _input_columns(settings: FeatureSettings) -> SeriesColumns:
    """Lagged and rolled inputs. Without step inputs everything is heart rate and strictly in the past."""
    specs = [S.previous_column("steps")]
    lags, windows = settings.lags, settings.roll_windows
    if settings.allow_step_inputs:
        columns = ["steps", "hr"] if settings.use_hr else ["steps"]
        if lags:
            specs += [S.lag_columns(c, lags) for c in columns]
        if windows:
            specs += [S.rolling_columns(c, windows) for c in columns]
    elif settings.use_hr:
        if lags:
            specs.append(S.lag_columns("hr", lags))
        specs.append(S.hr_dynamics_columns(delta=1 in lags))
        if windows:
            specs.append(S.rolling_columns("hr", windows, past_only=True))
    return S.combine(specs)


def build_features(
    signal: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    layout: Layout | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Series lengths are measured once; all stages share the exchange and sort of the first one. Without a layout the
    columns of the signal tell it.

    Lags and windows see only rows that passed the cadence filter and have a target, so they form a second
    stage after the filter.
    """
    layout = layout or layout_of(signal.columns)
    if settings.task == "daily_total":
        days = add_series_columns(
            S.daily_totals(signal, layout), S.previous_column("steps"), daily_layout(layout), no_hot_keys(layout)
        )
        days = known_target(days)
        return _encode(days.withColumn("ts", F.col("day").cast("timestamp_ntz")), settings, daily_layout(layout))
    if settings.task != "interval":
        raise ValueError(f"unknown task {settings.task!r}")
    hot = find_hot_keys(signal, layout.key) if hot is None else hot
    df = signal
    if settings.slot_and_day:
        df = df.withColumns({"slot_in_day": slot_in_day(layout.ts, settings.slot_minutes), "day": day_of(layout.ts)})

    early = []
    strict = settings.strict_step_minutes is not None
    if settings.gap or strict:
        early.append(S.gap_column(layout))
    if settings.horizon == 0:
        df = df.withColumn("steps_t", F.col("steps"))
    elif not strict:
        early.append(S.target_column("steps", settings.horizon))
    rows = DividedSeries.divide(df, layout, hot)
    if early:
        rows = rows.add(S.combine(early))
    if strict:
        rows = rows.keep(lambda df: strict_cadence(df, settings.strict_step_minutes))
        if settings.horizon:
            rows = rows.add(S.target_column("steps", settings.horizon))
        if not settings.gap:
            rows = rows.each(lambda df: df.drop("delta_minutes_from_prev"))

    rows = rows.keep(lambda df: known_target(df.withColumns(calendar_fields(settings.calendar, layout.ts))))
    df = rows.add(_input_columns(settings)).together()
    return _encode(df, settings, layout, hot)


def _encode(
    df: DataFrame, settings: FeatureSettings, layout: Layout, hot: HotKeys | None = None
) -> DataFrame:
    if settings.user_id_encoding == "onehot":
        return one_hot(df, layout.key)
    if settings.user_id_encoding == "vector":
        return one_hot_vector(df, layout.key, f"{layout.key}_vec", hot)
    if settings.user_id_encoding != "drop":
        raise ValueError(f"unknown encoding {settings.user_id_encoding!r}")
    return df
