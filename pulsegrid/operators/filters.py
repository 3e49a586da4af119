"""Row and series filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.skew import HotKeys, join_by_key


def series_rows(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Rows per series."""
    return df.groupBy(layout.key).agg(F.count(F.lit(1)).alias("rows"))


def series_days(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Distinct observed days per series."""
    days = df.select(layout.key, F.to_date(layout.ts).alias("day")).distinct()
    return days.groupBy(layout.key).agg(F.count("day").alias("days"))


def keep_series(
    df: DataFrame, keep: DataFrame, layout: Layout = DEFAULT_LAYOUT, hot: HotKeys | None = None
) -> DataFrame:
    """Rows whose series is listed in ``keep``."""
    return join_by_key(df, keep.select(layout.key), layout.key, "left_semi", hot)


def min_samples(
    df: DataFrame, rows: int, layout: Layout = DEFAULT_LAYOUT, hot: HotKeys | None = None
) -> DataFrame:
    return keep_series(df, series_rows(df, layout).where(F.col("rows") >= rows), layout, hot)


def min_days(
    df: DataFrame, days: int, layout: Layout = DEFAULT_LAYOUT, hot: HotKeys | None = None
) -> DataFrame:
    return keep_series(df, series_days(df, layout).where(F.col("days") >= days), layout, hot)


def known_target(df: DataFrame, target: str = "steps_t") -> DataFrame:
    return df.dropna(subset=[target])


def strict_cadence(
    df: DataFrame, step_minutes: float = 15, gap: str = "delta_minutes_from_prev"
) -> DataFrame:
    """Keep rows exactly one step after their predecessor, and first rows. Gaps are not computed anew."""
    return df.where(F.col(gap).isNull() | (F.col(gap) == F.lit(float(step_minutes))))


def on_days(df: DataFrame, days: DataFrame, inside: bool = True, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Rows inside (or outside) an explicit table of (series, day) hold-out days."""
    listed = days.select(layout.key, F.col("day").alias("_day"))
    rows = df.withColumn("_day", F.to_date(layout.ts))
    return rows.join(listed, [layout.key, "_day"], "left_semi" if inside else "left_anti").drop("_day").select(
        df.columns
    )
