from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import folds, splits

CASES = st.tuples(st.floats(0, 0.49), st.floats(0, 0.49), st.integers(0, 12), st.integers(0, 5), st.integers(0, 5))


def days_of(spark, lengths):
    """User u has lengths[u] observed days, three days apart, two rows a day."""
    rows = [(u, d, r) for u, n in enumerate(lengths) for d in range(n) for r in range(2)]
    df = spark.createDataFrame(rows, "user_id long, d int, r int")
    ts = F.timestamp_add("HOUR", F.col("d") * 72 + F.col("r") * 5, F.lit("2024-01-01").cast("timestamp_ntz"))
    return df.withColumns({"ts": ts, "event_id": F.monotonically_increasing_id()})


def counts(df):
    found = df.groupBy("user_id").pivot("split", ["train", "val", "test"]).agg(F.countDistinct("d"))
    return {r["user_id"]: tuple(r[s] or 0 for s in ("train", "val", "test")) for r in found.collect()}


def expected_share(n, val_pct, test_pct, minimum, min_val, min_test):
    if n < minimum:
        return n, 0, 0
    test = max(int(n * test_pct), min_test) if test_pct > 0 else 0
    val = max(int(n * val_pct), min_val) if val_pct > 0 else 0
    over = max(0, val + test - (n - 1))
    cut = min(val, over)
    val, test = val - cut, test - min(test, over - cut)
    return n - val - test, val, test


@settings(max_examples=10, deadline=None)
@given(CASES)
def test_share_of_days(spark, case):
    val_pct, test_pct, minimum, min_val, min_test = case
    lengths = [1, 2, 5, 9, 10, 11, 20]
    got = counts(splits.split_share_of_days(days_of(spark, lengths), val_pct, test_pct, minimum, min_val, min_test))
    assert got == {u: expected_share(n, *case) for u, n in enumerate(lengths)}


@pytest.mark.parametrize("val,test", [(2, 3), (3, 0), (0, 4), (0, 0)])
def test_last_days(spark, val, test):
    lengths = [1, 4, 5, 6, 12]
    got = counts(splits.split_last_days(days_of(spark, lengths), val, test))
    assert got == {u: (n - val - test, val, test) if n > val + test else (n, 0, 0) for u, n in enumerate(lengths)}


def test_parts_are_ordered_and_complete(spark, signal):
    rows = splits.split(signal, "per_user_pct")
    assert rows.count() == signal.count() and rows.where("split IS NULL").count() == 0
    spans = rows.groupBy("user_id").pivot("split", ["train", "val", "test"]).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    assert spans.where("train_z >= val_a OR val_z >= test_a").count() == 0
    assert spans.where("train_a IS NULL").count() == 0


def test_shares_are_checked(signal):
    for val, test in ((1.0, 0.0), (0.6, 0.5), (-0.1, 0.2)):
        with pytest.raises(ValueError):
            splits.split_share_of_days(signal, val, test)


def test_global_cut_is_inclusive_and_needs_a_time(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp_ntz'2024-01-01 10:00:00', timestamp_ntz'2024-01-01 10:00:01', "
        "timestamp_ntz'2024-01-02 00:00:00', timestamp_ntz'2024-01-03 00:00:00', CAST(NULL AS timestamp_ntz))) AS ts"
    )
    rows = splits.split(df, "global_time", train_until="2024-01-01 10:00:00", valid_until="2024-01-02")
    assert [r["split"] for r in rows.collect()] == ["train", "val", "val", "test", None]


def test_missing_user_has_no_part(spark, signal):
    rows = signal.withColumn("user_id", F.when(F.col("user_id") != 3, F.col("user_id")))
    split = splits.split_share_of_days(rows)
    assert split.where("(user_id IS NULL) != (split IS NULL)").count() == 0


@pytest.mark.parametrize("rows,k", [(10, 3), (11, 3), (100, 5), (6, 5)])
def test_expanding_folds(rows, k):
    found = folds.expanding_folds(rows, k)
    size = rows // (k + 1)
    assert [f.stop - f.start for f in found] == [size] * k
    assert found[-1].stop == rows and all(a.stop == b.start for a, b in zip(found, found[1:]))


def test_too_few_rows_for_folds():
    with pytest.raises(ValueError):
        folds.expanding_folds(3, 5)


def test_folds_follow_time(signal):
    rows = folds.assign_folds(signal, 4)
    spans = rows.groupBy("fold").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).orderBy("fold").collect()
    assert [r["fold"] for r in spans] == [-1, 0, 1, 2, 3]
    assert all(x["z"] <= y["a"] for x, y in zip(spans, spans[1:]))
