"""Mergeable quantile sketches: approximate percentiles with a stated rank error, without going back to the rows.

A KLL sketch of ``size`` k holds a few k values whatever the number of rows. The value it gives for a probability has, with
99 % confidence, a rank within ``rank_error(k)`` of the wanted one, as a share of the rows. Sketches of parts merge into one of
the whole with the same error, so they are stored per group and merged later, by run, by model or over users. Exact
percentiles are in ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.errors import absolute_error
from pulsegrid.operators.metrics import GROUP

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Greatest distance of ranks, as a share of the rows. The published error curve of KLL sketches."""
    return 2.296 / size**0.9021


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str | Column, size: int = SIZE) -> DataFrame:
    """The keys, ``n`` (values) and ``sketch`` per group; missing values and NaN take no part."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    sketch = F.kll_sketch_agg_double("_v", F.lit(size)).alias("sketch")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch)


def error_sketches(scored: DataFrame, keys: Sequence[str] = GROUP, size: int = SIZE) -> DataFrame:
    """Sketches of the absolute error per model and split, or per user."""
    return quantile_sketches(scored, keys, absolute_error(), size)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probabilities: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """The keys, ``n`` and one column per probability."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in probabilities.items()]
    return sketches.select(*keys, "n", *found)
