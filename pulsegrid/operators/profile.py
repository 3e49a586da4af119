"""Descriptive tables of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.calendar import calendar_field, slots_per_day
from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.baselines import CELL
from pulsegrid.operators.quantiles import exact_quantiles


def _date(df: DataFrame, layout: Layout):
    return F.col("date") if "date" in df.columns else F.to_date(layout.ts)


def user_day_table(
    df: DataFrame, slot_minutes: float = 22.5, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Rows per series and day, and whether the day is complete."""
    slots = slots_per_day(slot_minutes)
    days = df.groupBy(layout.key, _date(df, layout).alias("date")).agg(F.count(F.lit(1)).alias("rows"))
    return days.withColumn("complete", (F.col("rows") >= slots).cast("int"))


def per_user_table(
    df: DataFrame, slot_minutes: float = 22.5, value: str = "steps", layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Size, span, centre and share of zeros of each series.

    Counting goes over (series, day) first: distinct days come for free and a long series is combined in
    many tasks. Medians come from the two-pass order statistic.
    """
    v = F.col(value)
    days = df.groupBy(layout.key, _date(df, layout).alias("_date")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(layout.ts).alias("_first"),
        F.max(layout.ts).alias("_last"),
        F.sum(v).alias("_sum"),
        F.count(v).alias("_count"),
        F.count(F.when(v == 0, 1)).alias("_zeros"),
    )
    users = days.groupBy(layout.key).agg(
        F.sum("_rows").alias("rows"),
        F.count(F.lit(1)).alias("days"),
        F.min("_first").alias("first_ts"),
        F.max("_last").alias("last_ts"),
        (F.sum("_sum") / F.nullif(F.sum("_count"), F.lit(0))).alias("mean_steps"),
        (F.sum("_zeros") / F.sum("_rows")).alias("zero_frac"),
    )
    medians = exact_quantiles(df, [layout.key], value, {"median_steps": 0.5})
    slots = slots_per_day(slot_minutes)
    return users.join(medians, layout.key, "left").select(
        layout.key,
        "rows",
        "days",
        "first_ts",
        "last_ts",
        "mean_steps",
        "median_steps",
        "zero_frac",
        (F.col("rows") / F.nullif(F.col("days"), F.lit(0))).alias("rows_per_day"),
        F.floor(F.col("rows") / F.lit(slots)).cast("int").alias("days_complete_approx"),
    )


def hour_of_day_table(df: DataFrame, value: str = "steps", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Count, mean, median and sample standard deviation per hour; 24 rows."""
    rows = df.select(calendar_field("hour", layout.ts).alias("hour"), F.col(value).alias("v"))
    table = rows.groupBy("hour").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    medians = exact_quantiles(rows, ["hour"], "v", {"median": 0.5}, few_groups=True)
    return table.join(F.broadcast(medians), "hour", "left").select("hour", "count", "mean", "median", "std")


def prior_table(df: DataFrame, value: str = "steps", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    cells = [calendar_field(c, layout.ts).alias(c) for c in CELL]
    return df.groupBy(layout.key, *cells).agg(F.avg(value).alias("prior_usr_dow_hour"))


def summary_row(
    df: DataFrame,
    slot_minutes: float = 22.5,
    active_threshold: float = 50.0,
    value: str = "steps",
    hr: str = "hr",
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Whole-table facts in one row, all from one pass that groups by (series, day)."""
    has_hr = hr in df.columns
    v = F.col(value)
    days = df.groupBy(layout.key, _date(df, layout).alias("_date")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(layout.ts).alias("_first"),
        F.max(layout.ts).alias("_last"),
        F.count(F.when(v >= active_threshold, 1)).alias("_active"),
        (F.count(hr) if has_hr else F.lit(None).cast("bigint")).alias("_hr"),
    )
    slots = slots_per_day(slot_minutes)
    # distinct series: group once more by series, then everything adds up
    users = days.groupBy(layout.key).agg(
        F.sum("_rows").alias("_rows"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.sum("_active").alias("_active"),
        F.sum("_hr").alias("_hr"),
        F.count(F.lit(1)).alias("_days"),
        F.count(F.when(F.col("_rows") >= slots, 1)).alias("_complete"),
    )
    total = F.nullif(F.sum("_rows"), F.lit(0))
    return users.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.count(layout.key).alias("n_users"),
        F.min("_first").alias("date_start"),
        F.max("_last").alias("date_end"),
        F.lit(slots).alias("slots_per_day_expected"),
        F.lit(float(active_threshold)).alias("active_threshold"),
        (F.sum("_active") / total).alias("active_fraction"),
        (F.sum("_complete") / F.nullif(F.sum("_days"), F.lit(0))).alias("per_day_complete_fraction"),
        F.lit(has_hr).alias("hr_col_present"),
        (F.sum("_hr") / total).alias("hr_coverage"),
    )


def key_value(row: DataFrame) -> DataFrame:
    """One wide row to a key/value table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.inline(pairs))


def head_rows(df: DataFrame, rows: int = 100_000, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """First rows in (series, time) order, for a report."""
    return df.orderBy(*layout.full_order).limit(rows)
