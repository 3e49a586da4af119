"""Scoring: all error measures of all models and splits in one grouped pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import errors as E
from pulsegrid.operators.quantiles import attach, exact_quantiles

GROUP = ["model", "split"]
PERCENTILES = (50, 75, 90, 95)


def tolerance_name(k: float) -> str:
    return f"ToleranceAcc@{int(k) if float(k).is_integer() else k}"


def core_measures() -> dict[str, Column]:
    return {"MAE": E.mae(), "RMSE": E.rmse(), "MAPE": E.mape(), "R2": E.r2()}


def relative_measures() -> dict[str, Column]:
    return {"WAPE": E.wape(), "SMAPE": E.smape(), "MAPE_safe": E.mape_safe()}


def tolerance_measures(tolerances: Sequence[float]) -> dict[str, Column]:
    return {tolerance_name(k): E.tolerance_accuracy(k) for k in tolerances}


def loss_measures(taus: Sequence[float] = (0.5, 0.8), widths: Sequence[float] = (50,)) -> dict[str, Column]:
    out = {f"Pinball@{t}": E.pinball(t) for t in taus}
    for w in widths:
        out[f"Deadzone@{w}"] = E.deadzone(w)
        out[f"Deadzone2@{w}"] = E.deadzone(w, 2.0)
    return out


def _few(by: Sequence[str]) -> bool:
    return {*by} <= {*GROUP}


def error_percentiles(
    scored: DataFrame, percentiles: Sequence[float] = PERCENTILES, by: Sequence[str] = GROUP
) -> DataFrame:
    """Percentiles of the absolute error, interpolated. Only models x splits are known to be few groups."""
    wanted = {f"P{p}_abs_err": p / 100.0 for p in percentiles}
    return exact_quantiles(scored, by, E.absolute_error(), wanted, few_groups=_few(by))


def evaluate(
    scored: DataFrame,
    tolerances: Sequence[float] = (100,),
    percentiles: Sequence[float] = PERCENTILES,
    extra: Mapping[str, Column] | None = None,
    by: Sequence[str] = GROUP,
) -> DataFrame:
    """One row per group of a long scored table with ``y``, ``yhat`` and ``ref_prev``."""
    measures = {**core_measures(), **relative_measures(), **tolerance_measures(tolerances)}
    measures["DirectionalAcc"] = E.directional_accuracy()
    measures |= {"n_scored": E.pairs_scored(), "n_missing": E.pairs_missing(), **(extra or {})}
    table = scored.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])
    if not percentiles:
        return table
    return attach(table, error_percentiles(scored, percentiles, by), by, few_groups=_few(by))


def stack_scored(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of the scored tables of several models."""
    return reduce(DataFrame.unionByName, frames)


def scored_columns(
    df: DataFrame, model: str, y: str = "steps_t", yhat: str = "yhat", ref: str | None = "ref_prev", keep: Sequence[str] = ()
) -> DataFrame:
    """Narrow a predicted table to what scoring reads."""
    reference = F.col(ref).cast("double") if ref and ref in df.columns else F.lit(None).cast("double")
    return df.select(
        F.lit(model).alias("model"),
        "split",
        *keep,
        F.col(y).cast("double").alias("y"),
        F.col(yhat).cast("double").alias("yhat"),
        reference.alias("ref_prev"),
    )
