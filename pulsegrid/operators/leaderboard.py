"""Comparison of models: one row per model, lift over the naive forecast, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

NAIVE = "naive_last"
_NOT_MEASURES = ("model", "split")


def compare(metrics: DataFrame, train_measures: Sequence[str] = ("MAE",)) -> DataFrame:
    """Turn (model, split) rows into one row per model with ``{measure}_{split}`` columns."""
    names = [c for c in metrics.columns if c not in _NOT_MEASURES]
    pieces = []
    for split, chosen in (("train", [n for n in names if n in train_measures]), ("val", names), ("test", names)):
        for n in chosen:
            pieces.append(F.max(F.when(F.col("split") == split, F.col(f"`{n}`"))).alias(f"{n}_{split}"))
    return metrics.groupBy("model").agg(*pieces)


def add_lift(board: DataFrame, naive: str = NAIVE) -> DataFrame:
    """Share of the naive error that a model saves; missing for all models without a naive row."""
    base = board.where(F.lower("model") == naive)
    lifts = {}
    for split in ("val", "test"):
        error = f"MAE_{split}"
        reference = base.agg(F.max(error)).scalar()
        lifts[f"Lift_{split}_MAE"] = (reference - F.col(error)) / F.nullif(reference, F.lit(0.0))
    return board.withColumns(lifts)


def rank_models(board: DataFrame) -> DataFrame:
    """Position by validation MAE, then RMSE, missing last. The table has one row per model."""
    order = Window.orderBy(F.asc_nulls_last("MAE_val"), F.asc_nulls_last("RMSE_val"), F.asc("model"))
    ranked = board.withColumn("rank", F.row_number().over(order))
    return ranked.select("rank", *board.columns)


def leaderboard(metrics: DataFrame, naive: str = NAIVE) -> DataFrame:
    return rank_models(add_lift(compare(metrics), naive))
