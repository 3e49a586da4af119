"""Build job: nested cells to a sorted signal table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.layout import MATRIX_LAYOUT, Layout
from pulsegrid.sources.signal import explode_cells, read_table
from pulsegrid.sources.sinks import write_sorted


def build_signal(
    spark: SparkSession,
    cells_path: str,
    out_path: str,
    min_days: int = 50,
    format: str = "parquet",
    layout: Layout = MATRIX_LAYOUT,
    **options,
) -> DataFrame:
    cells = read_table(spark, cells_path, format, **options)
    write_sorted(explode_cells(cells, min_days), out_path, layout)
    return spark.read.parquet(out_path)
