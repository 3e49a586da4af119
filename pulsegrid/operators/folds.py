"""Expanding time folds over the global row order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.operators.skew import number_rows


@dataclass(frozen=True)
class Fold:
    """Rows ``[start, stop)`` are tested, all rows before ``start`` are trained on."""

    number: int
    start: int
    stop: int

    def train(self, index: str = "row_index") -> Column:
        return F.col(index) < self.start

    def test(self, index: str = "row_index") -> Column:
        return (F.col(index) >= self.start) & (F.col(index) < self.stop)


def expanding_folds(rows: int, splits: int) -> list[Fold]:
    size = rows // (splits + 1)
    if size == 0:
        raise ValueError(f"{rows} rows cannot be cut into {splits} expanding folds")
    starts = [rows - (splits - j) * size for j in range(splits)]
    return [Fold(j, start, start + size) for j, start in enumerate(starts)]


def time_index(df: DataFrame, layout: Layout = DEFAULT_LAYOUT, name: str = "row_index") -> DataFrame:
    """Global 0-based row number in time order across series."""
    return number_rows(df, [*layout.order, layout.key], name)


def assign_folds(df: DataFrame, splits: int, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add ``row_index`` and ``fold``, the number of the fold that tests the row (-1: only ever trained on)."""
    indexed = time_index(df, layout)
    folds = expanding_folds(indexed.count(), splits)
    first, size = folds[0].start, folds[0].stop - folds[0].start
    number = F.floor((F.col("row_index") - first) / F.lit(size)).cast("int")
    return indexed.withColumn("fold", F.when(F.col("row_index") < first, -1).otherwise(number))
