"""Time splits, expressed as one ``split`` column.

Per-series splits need only two day boundaries per series. They are computed on the distinct (series, day)
pairs, which are far fewer than rows and bounded by the calendar per series, and then joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.skew import HotKeys, join_by_key

TRAIN, VAL, TEST = "train", "val", "test"


def split_global(df: DataFrame, train_until: str, valid_until: str, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """train <= train_until < val <= valid_until < test; rows without a time get no split."""
    ts = F.col(layout.ts)
    first, second = (F.lit(t).cast("timestamp_ntz") for t in (train_until, valid_until))
    rule = F.when(ts <= first, TRAIN).when(ts <= second, VAL).when(ts.isNotNull(), TEST)
    return df.withColumn("split", rule)


def split_last_days(
    df: DataFrame,
    val_days: int = 14,
    test_days: int = 14,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Last ``test_days`` observed days of each series are test, the ``val_days`` before them val.

    A series with no more days than that stays in train as a whole.
    """
    enough = F.col("_days") > val_days + test_days
    n_test = F.when(enough, test_days).otherwise(0)
    n_val = F.when(enough, val_days).otherwise(0)
    return _split_by_day_counts(df, n_val, n_test, layout, hot)


def split_share_of_days(
    df: DataFrame,
    val_pct: float = 0.15,
    test_pct: float = 0.15,
    min_days_for_any_split: int = 10,
    min_val_days: int = 1,
    min_test_days: int = 1,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Last share of each series' observed days. At least one train day stays; val gives way before test."""
    if not (0 <= val_pct < 1 and 0 <= test_pct < 1 and val_pct + test_pct < 1):
        raise ValueError("val_pct and test_pct must lie in [0, 1) and sum to less than 1")
    n = F.col("_days")

    def share(pct: float, minimum: int) -> Column:
        days = F.floor(n * F.lit(float(pct)))
        return F.greatest(days, F.lit(minimum)) if pct > 0 else days

    n_val, n_test = share(val_pct, min_val_days), share(test_pct, min_test_days)
    over = F.greatest(F.lit(0), n_val + n_test - F.greatest(F.lit(0), n - 1))
    less_val = F.least(n_val, over)
    less_test = F.least(n_test, over - less_val)
    enough = n >= min_days_for_any_split
    return _split_by_day_counts(
        df,
        F.when(enough, n_val - less_val).otherwise(0),
        F.when(enough, n_test - less_test).otherwise(0),
        layout,
        hot,
    )


def _split_by_day_counts(
    df: DataFrame, n_val: Column, n_test: Column, layout: Layout, hot: HotKeys | None
) -> DataFrame:
    day = F.to_date(layout.ts)
    days = df.select(layout.key, day.alias("_day")).where(F.col("_day").isNotNull()).distinct()
    series = Window.partitionBy(layout.key)
    ranked = days.select(
        layout.key,
        "_day",
        F.row_number().over(series.orderBy(F.desc("_day"))).alias("_from_end"),
        F.count("_day").over(series).alias("_days"),
    )
    # null when the series gives no day to the part: comparisons with it are then never true
    test_from = F.min(F.when(F.col("_from_end") <= n_test, F.col("_day"))).alias("_test_from")
    val_from = F.min(F.when(F.col("_from_end") <= n_test + n_val, F.col("_day"))).alias("_val_from")
    bounds = ranked.groupBy(layout.key).agg(test_from, val_from)
    rule = (
        F.when(day >= F.col("_test_from"), TEST)
        .when(day >= F.col("_val_from"), VAL)
        .when(day.isNotNull() & F.col(layout.key).isNotNull(), TRAIN)
    )
    joined = join_by_key(df, bounds, layout.key, "left", hot)
    return joined.select(*df.columns, rule.alias("split"))


def split(
    df: DataFrame,
    mode: str = "global_time",
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
    **settings,
) -> DataFrame:
    """Split by mode name: ``per_user``, ``per_user_pct``; any other name means the global cut."""
    if mode == "per_user":
        return split_last_days(df, layout=layout, hot=hot, **settings)
    if mode == "per_user_pct":
        return split_share_of_days(df, layout=layout, hot=hot, **settings)
    return split_global(df, layout=layout, **settings)


def split_counts(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Rows and distinct series per split; series are counted in two combining steps."""
    per_series = df.groupBy("split", layout.key).agg(F.count(F.lit(1)).alias("_rows"))
    return per_series.groupBy("split").agg(
        F.sum("_rows").alias("rows"), F.count(F.col(layout.key)).alias("users")
    )
