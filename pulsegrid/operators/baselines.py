"""Forecasts without fitting: last value, calendar statistics, per-series priors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.calendar import calendar_field
from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.quantiles import exact_mode, exact_quantiles
from pulsegrid.session import freeze

CELL = ["dow", "hour"]
# Model name to statistic.
CALENDAR_BASELINES = {"averaging": "mean", "median": "median", "mode": "mode"}


def with_calendar(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Make sure ``dow`` and ``hour`` exist, from the time column if need be."""
    if set(CELL) <= set(df.columns):
        return df
    if layout.ts not in df.columns:
        raise ValueError(f"calendar baseline needs 'dow' and 'hour' or the time column {layout.ts!r}")
    return df.withColumns({f: calendar_field(f, layout.ts) for f in CELL})


def statistic(
    df: DataFrame, keys: list[str], value: str, how: str | Callable[[Column], Column], name: str, few_groups: bool = False
) -> DataFrame:
    """Mean, median or mode per group; no group is gathered in one buffer.

    ``how`` may also build an aggregate of one's own from the value column.
    """
    if callable(how):
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(how(F.col(value)).alias(name))
    if how == "mean":
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(name))
    if how == "median":
        return exact_quantiles(df, keys, value, {name: 0.5}, few_groups=few_groups)
    if how == "mode":
        return exact_mode(df, keys, value, name)
    raise ValueError(f"unsupported statistic {how!r}")


# Scopes of the statistic: one calendar cell, all rows with a calendar, all rows without one.
_CELL_SCOPE, _PLACED_SCOPE, _UNPLACED_SCOPE = 0, 1, 2


def _scoped(train: DataFrame, target: str, layout: Layout) -> DataFrame:
    """(scope, dow, hour, target): each row counts for its cell and for the whole."""
    rows = with_calendar(train, layout).where(F.col(target).isNotNull()).select(*CELL, target)
    placed = F.col("dow").isNotNull() & F.col("hour").isNotNull()
    nowhere = [F.lit(None).cast("int").alias(c) for c in CELL]
    cell = F.struct(F.lit(_CELL_SCOPE).alias("scope"), *[F.col(c).cast("int").alias(c) for c in CELL])
    whole = F.struct(F.lit(_PLACED_SCOPE).alias("scope"), *nowhere)
    rest = F.struct(F.lit(_UNPLACED_SCOPE).alias("scope"), *nowhere)
    scopes = F.when(placed, F.array(cell, whole)).otherwise(F.array(rest))
    return rows.select(F.explode(scopes).alias("_s"), target).select("_s.*", target)


_SCOPED = ["scope", *CELL]


def calendar_statistics(
    train: DataFrame, how: str | Callable[[Column], Column], target: str = "steps_t", layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Statistic of the target per (dow, hour) and over all rows, in one go: at most 170 rows.

    The copies of a row are combined before any exchange.
    """
    return statistic(_scoped(train, target, layout), _SCOPED, target, how, "value", few_groups=True)


def calendar_counts(train: DataFrame, target: str = "steps_t", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """How often each value occurs per (dow, hour) and over all rows, stored: mean, median and mode are read from it.

    Train rows are read once for all three. Counts are combined before the exchange, and a group is never gathered.
    """
    narrow = train.select(*[c for c in train.columns if c in {target, layout.ts, *CELL}])
    scoped = _scoped(narrow, target, layout)
    counted = scoped.groupBy(*_SCOPED, F.col(target).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return freeze(counted)


def statistic_of_counts(counts: DataFrame, how: str) -> DataFrame:
    """Mean, median or mode per scope from ``calendar_counts``."""
    if how == "mean":
        mean = F.sum(F.col("value") * F.col("rows")) / F.sum("rows")
        return counts.groupBy(*_SCOPED).agg(mean.alias("value"))
    if how == "median":
        return exact_quantiles(counts, _SCOPED, "value", {"value": 0.5}, few_groups=True, weight="rows")
    if how == "mode":
        best = F.min_by(F.col("value"), F.struct(-F.col("rows"), F.col("value")))
        return counts.groupBy(*_SCOPED).agg(best.alias("value"))
    raise ValueError(f"unsupported statistic {how!r}")


def calendar_table(train: DataFrame, how: str, target: str = "steps_t", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Statistic of the target per (dow, hour): at most 168 rows."""
    found = calendar_statistics(train, how, target, layout)
    return found.where(F.col("scope") == _CELL_SCOPE).select(*CELL, F.col("value").alias("cell_value"))


def calendar_forecast(
    df: DataFrame,
    how: str | Callable[[Column], Column],
    target: str = "steps_t",
    name: str = "yhat",
    layout: Layout = DEFAULT_LAYOUT,
    train: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Predict every row by its (dow, hour) statistic of the train rows, else by the global one, else by 0.

    The global value covers the rows in the calendar table, or all rows if none has a calendar. The lookup has
    at most 170 entries by design, so it is one map value, computed once as a scalar subquery; the rows are
    only projected. With ``counts`` of the train rows the statistic is read from these. The forecast is rounded to single precision, as the reported errors are defined on it.
    """
    if counts is not None and not callable(how):
        found = statistic_of_counts(counts, how)
    else:
        train = df.where(F.col("split") == "train") if train is None else train
        train = train.select(*[c for c in train.columns if c in {target, layout.ts, *CELL}])
        found = calendar_statistics(train, how, target, layout)
    entry = F.struct(
        F.when(F.col("scope") == _CELL_SCOPE, F.col("dow") * 24 + F.col("hour")).otherwise(-F.col("scope")),
        F.col("value").cast("double"),
    )
    lookup = found.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    keys = [F.col("dow") * 24 + F.col("hour"), F.lit(-_PLACED_SCOPE), F.lit(-_UNPLACED_SCOPE)]
    value = F.coalesce(*[F.try_element_at("_lookup", k.cast("int")) for k in keys], F.lit(0.0))
    rows = with_calendar(df, layout).withColumn("_lookup", lookup)
    return rows.select(*df.columns, value.cast("float").cast("double").alias(name))


def naive_forecast(df: DataFrame, lag: str = "steps_lag1", name: str = "yhat") -> DataFrame:
    if lag not in df.columns:
        raise ValueError(f"the naive forecast needs {lag!r}; add lags in the feature step")
    return df.withColumn(name, F.col(lag))


def user_priors(df: DataFrame, value: str = "steps_t", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Mean per (series, dow, hour)."""
    rows = with_calendar(df, layout)
    return rows.groupBy(layout.key, *CELL).agg(F.avg(value).alias("prior_usr_dow_hour"))


def add_user_prior(df: DataFrame, value: str = "steps_t", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Attach the train-only prior as a feature; unseen (series, dow, hour) stays missing.

    The join key has 168 cells per series, so even one dominating series spreads over many tasks.
    """
    rows = with_calendar(df, layout)
    priors = user_priors(rows.where(F.col("split") == "train"), value, layout)
    return rows.join(priors, [layout.key, *CELL], "left").select(*rows.columns, "prior_usr_dow_hour")
