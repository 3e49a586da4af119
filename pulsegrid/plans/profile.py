"""Profile job: descriptive tables of a signal, as a dictionary or written to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.layout import Layout, layout_of
from pulsegrid.operators import profile as P
from pulsegrid.sources.sinks import write_csv, write_report


def profile_tables(
    signal: DataFrame,
    slot_minutes: float = 22.5,
    active_threshold: float = 50.0,
    sample_rows: int = 100_000,
    layout: Layout | None = None,
) -> dict[str, DataFrame]:
    layout = layout or layout_of(signal.columns)
    value = "steps_t" if "steps_t" in signal.columns else "steps"
    hr = "heart_rate" if "heart_rate" in signal.columns else "hr"
    return {
        "summary": P.key_value(P.summary_row(signal, slot_minutes, active_threshold, value, hr, layout)),
        "per_user": P.per_user_table(signal, slot_minutes, value, layout),
        "hour_of_day": P.hour_of_day_table(signal, value, layout),
        "prior_user_dow_hour": P.prior_table(signal, value, layout),
        "by_user_day": P.user_day_table(signal, slot_minutes, layout),
        "dataset_sample": P.head_rows(signal, sample_rows, layout),
    }


def run_profile(
    signal: DataFrame, folder: str, flat: bool = True, layout: Layout | None = None, **settings
) -> dict[str, str]:
    """Write all tables, and the whole flat table in (series, time) order as CSV if asked for."""
    layout = layout or layout_of(signal.columns)
    paths = write_report(profile_tables(signal, layout=layout, **settings), folder, csv=True)
    if flat:
        paths["dataset_flat"] = f"{folder}/dataset_flat"
        write_csv(signal.orderBy(*layout.full_order), paths["dataset_flat"])
    return paths
