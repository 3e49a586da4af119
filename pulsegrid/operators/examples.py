"""Tables behind the example charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.skew import HotKeys, find_hot_keys, join_by_key, number_in_series


def first_scored(scored: DataFrame, rows: int = 500, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """First rows in time order; Spark keeps only the top rows of each partition."""
    return scored.orderBy(*layout.order, layout.key).limit(rows)


def true_value(df: DataFrame) -> Column:
    """Current value if there, else target, else the scored truth."""
    for name in ("steps", "steps_t", "y"):
        if name in df.columns:
            return F.col(name)
    raise ValueError("no column with true values")


def pick_series(df: DataFrame, rank: int, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Key of the eligible series at 0-based position ``rank`` in order of first appearance, else the last one."""
    starts = df.groupBy(layout.key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*layout.order)).alias("_first")
    )
    leading = starts.where(F.col("_n") >= 10).orderBy("_first", layout.key).limit(rank + 1)
    return leading.orderBy(F.desc("_first"), F.desc(layout.key)).limit(1).select(layout.key)


def gap_example(
    predicted: DataFrame,
    yhat: str = "yhat",
    user_rank: int | None = None,
    max_days: int = 14,
    middle_share: float = 0.05,
    middle_min: int = 8,
    middle_max: int = 64,
    min_rows: int = 10,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """First two weeks of a series with a small middle slice hidden and predicted.

    For every series with ``min_rows`` known rows, or for the one at ``user_rank``.
    """
    rows = predicted.select(
        layout.key,
        *layout.order,
        true_value(predicted).alias("true_steps"),
        F.col(yhat).alias("pred_steps"),
    ).where(F.col(layout.ts).isNotNull() & F.col("true_steps").isNotNull())
    if user_rank is not None:
        rows = rows.join(F.broadcast(pick_series(rows, user_rank, layout)), layout.key, "left_semi")
    day = F.to_date(layout.ts)
    days = rows.groupBy(layout.key, day.alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    series = Window.partitionBy(layout.key)
    days = days.withColumns(
        {
            "_nth": F.row_number().over(series.orderBy("_day")),
            "_all": F.sum("_rows").over(series),
        }
    )
    spans = (
        days.where((F.col("_nth") <= max_days) & (F.col("_all") >= min_rows))
        .groupBy(layout.key)
        .agg(F.max("_day").alias("_until"), F.sum("_rows").alias("_points"))
        .where(F.col("_points") >= 4)
    )
    hot = find_hot_keys(rows, layout.key) if hot is None else hot
    inside = join_by_key(rows, spans, layout.key, "inner", hot).where(day <= F.col("_until"))
    placed = number_in_series(inside, layout, "position", hot)
    middle = F.least(
        F.greatest(F.floor(F.col("_points") * F.lit(float(middle_share))), F.lit(middle_min)),
        F.lit(middle_max),
        F.col("_points") - 2,
    )
    start = F.floor((F.col("_points") - middle) / F.lit(2))
    hidden = (F.col("position") >= start) & (F.col("position") < start + middle)
    return placed.select(
        layout.key,
        *layout.order,
        "position",
        "true_steps",
        "pred_steps",
        hidden.alias("hidden"),
        F.when(~hidden, F.col("true_steps")).alias("observed_steps"),
        F.when(hidden, F.col("pred_steps")).alias("filled_steps"),
    )
