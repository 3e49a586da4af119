"""Fits of a grid search side by side: which are started, and passes that they make together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pulsegrid.models import together
from pulsegrid.models.binned import BinnedRows, feature_edges
from pulsegrid.models.blocks import add_to, array_pieces
from pulsegrid.models.search import GridSearchedTrees


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(600).select(
        (F.col("id") % 5).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * 37 % 101 * 3 + F.col("id") % 7).cast("double").alias("label"),
        F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
    )
    return VectorAssembler(inputCols=["a"], outputCol="features").transform(df).drop("a").repartition(3).cache()


def test_no_fit_of_a_later_fold_is_started_for_what_the_first_folds_rule_out(frame):
    search = GridSearchedTrees({"learning_rate": [0.9, 0.001, 0.002], "max_iter": [3]}, folds=5, workers=5, valid_share=0.0)
    search.fit(frame)
    assert [r["n_folds"] for r in search.results] == [5, 2, 2]
    assert search.fits == 9


@pytest.mark.parametrize("pieces", [None, array_pieces((600,))])
def test_passes_of_fits_side_by_side_are_one(frame, monkeypatch, pieces):
    base = frame.select("features", F.col("label").alias("_y"), F.lit(1.0).alias("_w"), F.col("event_id").alias("_row"), F.lit(False).alias("_held"))
    stored = BinnedRows.store(base, feature_edges(base))
    made = []
    several = together.fold_several
    monkeypatch.setattr(together, "fold_several", lambda *how: made.append(how) or several(*how))
    monkeypatch.setattr("pulsegrid.models.blocks._FEW_BYTES", 0)
    rows = stored.together(together.Passes(stored))

    def work(power):
        return lambda block: np.bincount(block.row, block.y**power, minlength=600)

    with ExitStack() as members, ThreadPoolExecutor(3) as pool:
        for _ in range(3):
            members.enter_context(rows.passes.member())
        found = list(pool.map(lambda power: rows.fold(work(power), add_to, pieces), (1, 2, 3)))
    assert len(made) == 1
    for power, one in zip((1, 2, 3), found):
        assert one == pytest.approx(stored.fold(work(power), add_to, pieces))


def test_what_one_finds_out_the_others_wait_for(frame):
    base = frame.select("features", F.col("label").alias("_y"), F.lit(1.0).alias("_w"), F.col("event_id").alias("_row"), F.lit(False).alias("_held"))
    passes = together.Passes(BinnedRows.store(base, feature_edges(base)))
    assert passes.claim(["a", "b"]) == ["a", "b"] and passes.claim(["b", "c"]) == ["c"]
    with ThreadPoolExecutor(1) as pool:
        waiting = pool.submit(passes.wait_for_others, ["b"])
        passes.settle(["a", "c"])
        assert not waiting.done()
        passes.settle(["b"])
        waiting.result(timeout=10)
