"""Exact order statistics per group, whatever the size of the group.

The built-in exact percentile keeps all distinct values of a group in one buffer. Here a group is first counted
in fine value ranges (map-side combined), the ranges that hold the wanted ranks are found from the counts, and
only the rows of those ranges are ordered. The value range of a double is a pure function of the value, so both
passes agree without any shared state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Ranges per power of two. Finer ranges cost more counts and leave fewer rows to order.
RANGES_PER_OCTAVE = 4096
_LOWEST_OCTAVE = 1100  # below the smallest exponent of a double
_HIGHEST_OCTAVE = 1025.0


def value_range(column: str, per_octave: int = RANGES_PER_OCTAVE) -> Column:
    """Number of the value range; never decreases when the value grows. NULL stays NULL."""
    step = f"floor(least(log2(abs({column})), {_HIGHEST_OCTAVE}D) * {per_octave}) + {_LOWEST_OCTAVE * per_octave + 1}"
    return F.expr(f"CASE WHEN {column} > 0 THEN {step} WHEN {column} < 0 THEN -({step}) WHEN {column} = 0 THEN 0L END")


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return test


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probabilities: Mapping[str, float],
    few_groups: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per group that has a value, one column per entry of ``probabilities``, linear interpolation.

    ``few_groups`` states that the number of groups is bounded by design (hours, calendar cells, models); then
    the wanted ranges, at most two per probability and group, are broadcast and the rows never shuffle. Otherwise
    what is exchanged are distinct values with their counts. ``weight`` names a column of counts: a row then stands
    for that many rows.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    held = [F.col(weight).cast("long").alias("_w")] if weight else []
    rows_in = "sum(_w)" if weight else "count(1)"
    rows = df.select(*keys, value.cast("double").alias("_v"), *held).where("_v IS NOT NULL AND NOT isnan(_v)")
    rows = rows.withColumn("_range", value_range("_v"))

    names = [f"`{k}`" for k in keys]
    group = ", ".join(names or ["0"])
    if few_groups:
        counts = rows.groupBy(*keys, "_range").agg(F.expr(f"{rows_in} AS _n"))
    else:
        # equal values collapse before any exchange, so a value that fills a long series is no hot key of the join
        rows = rows.groupBy(*keys, "_range", "_v").agg(F.expr(f"{rows_in} AS _n"))
        counts = rows.groupBy(*keys, "_range").agg(F.expr("sum(_n) AS _n"))
    counts = counts.selectExpr(
        *names,
        "_range",
        "_n",
        f"sum(_n) OVER (PARTITION BY {group} ORDER BY _range"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS _total",
        f"coalesce(sum(_n) OVER (PARTITION BY {group} ORDER BY _range"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before",
    )
    ranks = [f"{float(p)!r}D * (_total - 1)" for p in probabilities.values()]
    ends = ", ".join(f"floor({r}), ceil({r})" for r in ranks)
    marks = counts.where(f"exists(array({ends}), r -> r >= _before AND r < _before + _n)").drop("_n")
    if few_groups:
        marks = F.broadcast(marks)

    picked = rows.alias("r").join(marks.alias("m"), _same([*keys, "_range"], "r", "m"))
    kept = ["_total", "_before", "_v", *((["_w"] if weight else []) if few_groups else ["_n"])]
    picked = picked.selectExpr(*[f"r.{n} AS {n}" for n in names], "r._range AS _range", *kept)
    if few_groups:
        picked = picked.groupBy(*keys, "_range", "_total", "_before", "_v").agg(F.expr(f"{rows_in} AS _n"))
    inside = ", ".join([*names, "_range"])
    start = (
        f"_before + coalesce(sum(_n) OVER (PARTITION BY {inside} ORDER BY _v"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    )
    picked = picked.selectExpr(*names, "_total", "_v", "_n", f"{start} AS _first")

    pieces = ["max(_total) AS _total"]
    for i, r in enumerate(ranks):
        for side in ("floor", "ceil"):
            pieces.append(f"max(CASE WHEN {side}({r}) >= _first AND {side}({r}) < _first + _n THEN _v END) AS _{side}{i}")
    found = picked.groupBy(*keys).agg(*[F.expr(x) for x in pieces]).where("_total IS NOT NULL")
    results = [
        f"_floor{i} + ({r} - floor({r})) * (_ceil{i} - _floor{i}) AS `{name}`"
        for i, (name, r) in enumerate(zip(probabilities, ranks))
    ]
    return found.selectExpr(*names, *results)


def exact_mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, the smallest one on a tie; both steps combine on the map side."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(name)
    return counts.groupBy(*keys).agg(best)


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str], few_groups: bool = False) -> DataFrame:
    """Left join of group results on keys that may be NULL; ``keys`` empty means one row for all."""
    side = F.broadcast(lookup) if few_groups or not keys else lookup
    names = [c for c in lookup.columns if c not in keys]
    joined = df.alias("l").join(side.alias("r"), _same(keys, "l", "r"), "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in names])
