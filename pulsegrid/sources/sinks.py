"""Writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.layout import DEFAULT_LAYOUT, Layout


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_sorted(df: DataFrame, path: str, layout: Layout = DEFAULT_LAYOUT) -> None:
    """Write in (series, time) order.

    Range partitioning keeps files of similar size even when one series dominates, and gives each file a
    narrow key range, so later filters skip files by their statistics.
    """
    order = layout.full_order
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Put the result rows of a run into the table of all runs.

    Rows are staged and then take the place of what the table had for the same run and model, in one commit. A run that
    is recorded twice, one after the other or at the same time, has one set of rows; other runs are not touched.
    """
    missing = {"run_id", "model"} - {*rows.columns}
    if missing:
        raise ValueError(f"result rows need {sorted(missing)}")
    placed = rows.withColumns({"of_run": F.col("run_id"), "of_model": F.col("model")})
    staged = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    staged.partitionBy("of_run", "of_model").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The table of all runs, without the folders' names."""
    return spark.read.parquet(path).drop("of_run", "of_model")


def write_report(tables: Mapping[str, DataFrame], folder: str, csv: bool = False) -> dict[str, str]:
    """Write every table of a report into its own folder."""
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder}/{name}"
        (write_csv if csv else write_table)(table, paths[name])
    return paths
