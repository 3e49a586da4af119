from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.functions import calendar as C
from pulsegrid.layout import MATRIX_LAYOUT
from pulsegrid.operators.encode import category_list, fill_missing, impute_mean, numeric_features, one_hot, one_hot_vector
from pulsegrid.operators.filters import strict_cadence
from pulsegrid.operators.series import add_gap_minutes
from pulsegrid.operators.skew import no_hot_keys
from pulsegrid.plans.build import build_signal
from pulsegrid.sources import sinks
from pulsegrid.sources.signal import CELL_SCHEMA, coerce_signal, explode_cells

import pytest

D = 739252.0  # 2024-01-01
NAN = float("nan")


def cells(spark):
    two = [[D, D + 1], [D + 0.5, D + 1.5]]
    return spark.createDataFrame(
        [
            (1, [[1.0, NAN], [3.0, None]], [[60.0, 61.0], [62.0, 63.0]], [D, D + 1], two),
            (2, [[5.0, 6.0], [7.0, 8.0]], [], [D, D + 1], two),
            (3, [[5.0, 6.0], [7.0, 8.0]], None, [D], two),
            (4, [], [], [D, D + 1], []),
            (5, None, None, None, None),
        ],
        CELL_SCHEMA,
    )


def test_explode(spark):
    rows = explode_cells(cells(spark), min_days=2).orderBy("user_id", "row_idx", "col_idx").collect()
    assert [(r["user_id"], r["row_idx"], r["col_idx"]) for r in rows] == [
        (u, r, c) for u in (1, 2) for r in (0, 1) for c in (0, 1)
    ]
    assert [r["steps"] for r in rows[:4]] == [1.0, None, 3.0, None]
    assert [r["hr"] for r in rows] == [60.0, 61.0, 62.0, 63.0, None, None, None, None]
    assert rows[2]["ts"] == dt.datetime(2024, 1, 1, 12) and rows[3]["date"] == dt.date(2024, 1, 2)


def test_short_calendar_passes_without_minimum(spark):
    rows = explode_cells(cells(spark)).where("user_id = 3").orderBy("row_idx", "col_idx").collect()
    assert [r["date"] for r in rows] == [dt.date(2024, 1, 1), None] * 2


def test_flat_cell_is_one_row(spark):
    flat = spark.createDataFrame(
        [(9, [1.0, 2.0, 3.0], None, [D, D + 1, D + 2], [D, D + 1, D + 2]), (8, [], None, [D], [])],
        "user_id long, steps array<double>, hr array<double>, date_dnum array<double>, dt_dnum array<double>",
    )
    rows = explode_cells(flat, promote_1d=True).orderBy("col_idx").collect()
    assert [(r["user_id"], r["row_idx"], r["col_idx"], r["steps"]) for r in rows] == [(9, 0, 0, 1.0), (9, 0, 1, 2.0), (9, 0, 2, 3.0)]


def test_day_numbers_against_python(spark):
    values = [D, D + 0.5, D + 1 / 3, 730000.123456, 719529.0, 739252.99999]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(C.day_number_to_timestamp("x").alias("t"))
    for v, row in zip(values, df.collect()):
        exact = dt.datetime.fromordinal(int(v)) + dt.timedelta(days=v % 1) - dt.timedelta(days=366)
        assert abs(row["t"] - exact) <= dt.timedelta(microseconds=2)


def test_coercion(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 10:15:00", "2024-01-01", "5", "x"), ("bad", "bad", "", "NaN"), (None, None, None, "61.5")],
        "ts string, date string, steps string, hr string",
    )
    rows = coerce_signal(raw).collect()
    assert [r["ts"] for r in rows] == [dt.datetime(2024, 1, 1, 10, 15), None, None]
    assert [r["steps"] for r in rows] == [5.0, None, None]
    assert [r["hr"] for r in rows] == [None, None, 61.5]


def test_build_job_writes_sorted_signal(spark, tmp_path):
    cells(spark).write.parquet(str(tmp_path / "cells"))
    out = build_signal(spark, str(tmp_path / "cells"), str(tmp_path / "signal"), min_days=2)
    assert out.count() == 8
    with_json = str(tmp_path / "json")
    cells(spark).where("user_id = 2").write.json(with_json)
    read = spark.read.schema(CELL_SCHEMA).json(with_json)
    assert explode_cells(read).agg(F.sum("steps")).first()[0] == 26.0
    assert MATRIX_LAYOUT.order == ["ts", "col_idx", "row_idx"]


def grid(spark):
    """Three users, two days of 96 slots, some slots removed."""
    slots = spark.range(3 * 2 * 96).select(
        (F.col("id") % 3).alias("user_id"), F.floor(F.col("id") / 3).cast("int").alias("slot"), F.col("id").alias("event_id")
    )
    ts = F.timestamp_add("MINUTE", F.col("slot") * 15, F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = slots.withColumns({"ts": ts, "steps": F.col("slot").cast("double"), "hr": F.lit(60.0)})
    return rows.where(~((F.col("user_id") == 1) & F.col("slot").isin(10, 11, 50)))


def test_cadence_on_a_regular_grid(spark):
    gaps = add_gap_minutes(grid(spark), hot=no_hot_keys())
    kept = strict_cadence(gaps, 15)
    dropped = gaps.join(kept, ["user_id", "event_id"], "left_anti").orderBy("slot").collect()
    assert [(r["user_id"], r["slot"], r["delta_minutes_from_prev"]) for r in dropped] == [(1, 12, 45.0), (1, 51, 30.0)]


def test_slots(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 23:59:59' AS ts")
    row = df.select(C.slot_in_day().alias("a"), C.slot_in_day(slot_minutes=22.5).alias("b"), C.calendar_field("dow").alias("d")).first()
    assert (row["a"], row["b"], row["d"]) == (95, 63, 6)
    assert C.slots_per_day(22.5) == 64
    with pytest.raises(ValueError):
        C.calendar_field("week")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "m", 1.0)], "run_id string, model string, MAE double")
    results = str(tmp_path / "results")
    for run, value in (("r1", 1.0), ("2024", 2.0), ("r1", 3.0)):
        sinks.append_results(df.withColumns({"run_id": F.lit(run), "MAE": F.lit(value)}), results)
    found = sinks.read_results(spark, results)
    assert found.columns == df.columns and {tuple(r) for r in found.collect()} == {("r1", "m", 3.0), ("2024", "m", 2.0)}
    with pytest.raises(ValueError):
        sinks.append_results(df.drop("run_id"), str(tmp_path / "results"))
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "new" / "folder" / "table"))
    assert spark.read.parquet(str(tmp_path / "new" / "folder" / "table")).count() == 1
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns


def test_numeric_features_and_fill(spark):
    df = spark.createDataFrame([(1, 2.0, None, "t", 5.0)], "user_id long, steps double, hr double, name string, steps_t double")
    assert numeric_features(df) == ["user_id", "hr"]
    assert numeric_features(df, drop_current=False, exclude=["user_id"]) == ["steps", "hr"]
    with pytest.raises(ValueError):
        numeric_features(df.drop("steps_t"))
    filled = fill_missing(df, ["hr"], as_float=True)
    assert filled.first()["hr"] == 0.0 and dict(filled.dtypes)["hr"] == "float"


def test_imputer(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "x double")
    assert sorted(r["x"] for r in impute_mean(df, ["x"]).collect()) == [1.0, 2.5, 4.0]


def test_one_hot_forms_agree(spark):
    df = spark.createDataFrame([(10,), (2,), (2,), (33,)], "user_id long")
    wide = one_hot(df)
    assert wide.columns == ["user_id", "user_id_10", "user_id_33"]
    sparse = {r["user_id"]: r["user_id_vec"].toArray().tolist() for r in one_hot_vector(df).collect()}
    for r in wide.collect():
        assert sorted(sparse[r["user_id"]]) == sorted([float(r["user_id_10"]), float(r["user_id_33"])])
    assert sum(sparse[2]) == 0.0
    assert category_list(df, "user_id") == [2, 10, 33]
    assert one_hot(df, categories=[33, 2]).columns == ["user_id", "user_id_33"]
    one = df.where("user_id = 2")
    assert one_hot_vector(one).columns == one.columns  # the only category is the dropped one


def test_null_for_nan(spark):
    df = spark.createDataFrame([(NAN,), (1.0,), (None,)], "x double").select(C.null_if_nan(F.col("x")).alias("x"))
    assert [r["x"] for r in df.collect()] == [None, 1.0, None]


def test_onehot_query_never_lists_all_users_for_a_row(spark, tmp_path):
    from pulsegrid.checks.tables import onehot_users

    when = dt.datetime(2024, 1, 1)
    events = [(i, when + dt.timedelta(minutes=i), user, "view", 1.0, '{"k": 1}') for i, user in enumerate([7, 7, 3, 9, None])]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, kinds).write.parquet(str(tmp_path / "events.parquet"))
    found = onehot_users(spark, str(tmp_path))
    assert "UDF(user_id_vec" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["user_id"]: (r["size"], r["active"], r["rows"]) for r in found.collect() if r["user_id"] is not None}
    assert rows == {3: (2, None, 1), 7: (2, 1, 2), 9: (2, 0, 1)}
