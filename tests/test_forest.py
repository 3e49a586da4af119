"""Forests: against a plain tree, and the same however rows are divided between passes and tasks."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.feature import VectorAssembler

from pulsegrid.models import ensemble, forest
from pulsegrid.models.binned import feature_edges
from pulsegrid.models.forest import RandomForest
from pulsegrid.models.growth import Limits
from pulsegrid.models.store import load_model, save_model


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=700), rng.integers(0, 9, 700), rng.exponential(2, 700)])
    return x, 5 * np.sin(x[:, 0]) + x[:, 1] * (x[:, 2] > 1) + rng.normal(0, 0.3, 700)


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(*data))]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, label double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).drop("a", "b", "c").cache()


def predict(model, df):
    return np.array([r["yhat"] for r in model.transform(df).orderBy("event_id").select("yhat").collect()])


def plain_forecast(bins, y, rows, min_leaf):
    """Mean of each leaf of a tree grown as far as the least leaf allows, by trying every split."""
    found = (1e-9, None)
    whole = y[rows].sum() ** 2 / len(rows)
    for f in range(len(bins)):
        for b in np.unique(bins[f, rows]):
            left = bins[f, rows] <= b
            n = int(left.sum())
            if min(n, len(rows) - n) >= min_leaf:
                gain = y[rows[left]].sum() ** 2 / n + y[rows[~left]].sum() ** 2 / (len(rows) - n) - whole
                if gain > found[0] * (1 + 1e-12):
                    found = (gain, left)
    if found[1] is None:
        return {int(i): y[rows].mean() for i in rows}
    return {**plain_forecast(bins, y, rows[found[1]], min_leaf), **plain_forecast(bins, y, rows[~found[1]], min_leaf)}


@pytest.mark.parametrize("finish", [90, 10_000])
def test_tree_equals_plain_recursion(data, frame, finish):
    x, y = data
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(feature_edges(frame, 40))])
    expected = plain_forecast(bins, y, np.arange(len(y)), 5)
    model = RandomForest(trees=1, bins=40, bootstrap=False, finish=finish).fit(frame)
    assert predict(model, frame) == pytest.approx([expected[i] for i in range(len(y))], abs=1e-9)


def test_division_does_not_matter(frame):
    settings = dict(trees=5, min_leaf=3)
    few, many = RandomForest(finish=100, together=2, **settings).fit(frame), RandomForest(finish=5000, **settings).fit(frame.repartition(1))
    assert predict(few, frame) == pytest.approx(predict(many, frame), abs=1e-9)


def test_rows_are_drawn_with_replacement():
    row = np.arange(200_000, dtype=np.int64) * 7919
    drawn = forest.copies(row, 3, 42)
    share = np.bincount(drawn.astype(int), minlength=6)[:6] / len(row)
    assert share == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)], abs=0.004)
    assert abs(np.corrcoef(drawn, forest.copies(row, 4, 42))[0, 1]) < 0.01


def test_forest_beats_its_trees_and_is_saved(spark, data, frame, tmp_path):
    _, y = data
    model = RandomForest(trees=12, min_leaf=2).fit(frame.where("event_id % 3 > 0"))
    rest = np.arange(len(y)) % 3 == 0
    error = lambda m: np.abs(predict(m, frame) - y)[rest].mean()
    single = RandomForest(trees=1, min_leaf=2).fit(frame.where("event_id % 3 > 0"))
    assert error(model) < error(single) and error(model) < 0.5 * np.abs(y - y.mean()).mean()
    save_model(spark, model, str(tmp_path / "f"))
    assert predict(load_model(spark, str(tmp_path / "f")), frame) == pytest.approx(predict(model, frame))


def test_depth_limit(frame):
    model = RandomForest(trees=2, depth=2, min_leaf=1, finish=200).fit(frame)
    assert max(len(bin(int(r["node"]))) - 3 for r in model.nodes.collect()) == 2


def test_branch_of_equal_rows_is_a_leaf():
    bins = np.zeros((2, 9), dtype=np.uint8)
    assert list(forest.grow_branch(bins, np.arange(9.0), np.ones(9), 1, 0, Limits(None, None, 1))) == [(1, -1, -1, 4.0)]

def test_large_forest_is_scored_branch_by_branch(frame, monkeypatch):
    model = RandomForest(trees=3, min_leaf=3, finish=60).fit(frame)
    assert model.nodes.where("branch IS NULL").count() > 3  # upper parts and branches are both walked
    at_once = predict(model, frame)
    monkeypatch.setattr(forest, "_WHOLE", 10)
    monkeypatch.setattr(ensemble, "tree_sum_of", None)  # the whole forest in one place
    apart = forest.RandomForestModel(model.nodes, model.trees).transform(frame)
    assert apart.columns == [*frame.columns, "yhat"] and apart.count() == frame.count()
    assert predict(forest.RandomForestModel(model.nodes, model.trees), frame) == pytest.approx(at_once, abs=1e-9)


def test_histograms_of_a_forest_stay_in_the_tasks(frame, monkeypatch):
    received = []
    collect = RDD.collect

    def watched(rdd):
        found = collect(rdd)
        received.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", watched)
    RandomForest(trees=4, finish=40, min_leaf=1).fit(frame)
    assert max(received) < 20_000  # a histogram alone has 3 inputs x 256 bins x 3 sums of 8 bytes
