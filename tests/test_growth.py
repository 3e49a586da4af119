"""Trees from binned rows: against a plain best-first tree, and whole fits against plain boosting."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pulsegrid.models import binned, blocks, ensemble, growth
from pulsegrid.models.binned import BinnedRows, feature_edges, group_quantiles
from pulsegrid.models.boosting import BoostedTrees
from pulsegrid.models.growth import Limits
from pulsegrid.models.store import load_model, save_model


def plain_tree(bins, pull, curve, limits):
    """(splits as (rows left, rows right), leaves as row sets): opens the leaf of greatest gain, one at a time."""

    def score(rows):
        down = curve[rows].sum() + limits.l2
        return pull[rows].sum() ** 2 / down if down > 0 else 0.0

    def best(rows, depth):
        found = (0.0, None, None)
        if limits.depth is not None and depth >= limits.depth:
            return found
        for f in range(len(bins)):
            for b in range(int(bins.max()) + 1):
                left, right = rows[bins[f, rows] <= b], rows[bins[f, rows] > b]
                if min(len(left), len(right)) < max(limits.min_leaf, 1):
                    continue
                if min(curve[left].sum(), curve[right].sum()) < limits.min_curvature:
                    continue
                gain = score(left) + score(right) - score(rows)
                if gain > found[0] * (1 + 1e-9) + 1e-9:
                    found = (gain, f, b)
        return found

    leaves = [(np.arange(bins.shape[1]), 0)]
    while limits.leaves is None or len(leaves) < limits.leaves:
        gains = [best(rows, depth) for rows, depth in leaves]
        at = max(range(len(leaves)), key=lambda i: gains[i][0])
        gain, f, b = gains[at]
        if gain <= 1e-9:
            break
        rows, depth = leaves.pop(at)
        leaves += [(rows[bins[f, rows] <= b], depth + 1), (rows[bins[f, rows] > b], depth + 1)]
    return {tuple(rows.tolist()) for rows, _ in leaves}


def grown_tree(bins, pull, curve, limits, passes=None):
    size = int(bins.max()) + 1
    everything = np.arange(bins.shape[1])

    def measure(splits, requests):
        if passes is not None:
            passes.append(len(requests))
        return growth.requested(bins, splits, requests, pull, curve, size, everything)

    root = growth.histogram(bins, everything, pull, curve, size)
    return growth.grow(root, measure, limits)


LIMITS = [Limits(leaves=8, min_leaf=5), Limits(leaves=31, min_leaf=1), Limits(leaves=None, depth=3, min_leaf=4),
          Limits(leaves=12, depth=4, min_leaf=2, l2=3.0), Limits(leaves=10, min_leaf=1, min_curvature=9.0)]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("seed", [1, 2])
def test_best_first_tree(limits, seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 12, size=(3, 240)).astype(np.uint8)
    curve = rng.uniform(0.5, 1.5, 240)
    pull = np.sin(bins[0]) * 3 + (bins[1] > 5) * bins[2] + rng.normal(0, 0.5, 240)
    tree = grown_tree(bins, pull, curve, limits)
    rows = growth.routes(bins, tree.splits)
    assert {tuple(r.tolist()) for r in rows.values()} == plain_tree(bins, pull, curve, limits)
    for leaf in tree.leaves:
        at = rows[leaf.node]
        assert leaf.stats == pytest.approx([pull[at].sum(), curve[at].sum(), len(at)])


def test_a_tree_takes_as_many_passes_as_it_is_deep():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 250, size=(5, 4000)).astype(np.uint8)
    pull = np.sin(bins[0] / 20) + np.cos(bins[1] / 30) + rng.normal(0, 0.1, 4000)
    passes = []
    tree = grown_tree(bins, pull, np.ones(4000), Limits(leaves=31), passes)
    depth = max(leaf.depth for leaf in tree.leaves)
    assert len(tree.leaves) == 31 and len(passes) <= depth and max(passes) <= 30


def test_constant_rows_stay_one_leaf():
    bins = np.zeros((2, 50), dtype=np.uint8)
    tree = grown_tree(bins, np.ones(50), np.ones(50), Limits())
    assert tree.splits == [] and len(tree.leaves) == 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 6, 900), rng.exponential(3, 900)])
    x[::50, 0] = np.nan
    y = np.round(10 + 4 * np.nan_to_num(x[:, 0]) + x[:, 1] ** 2 + rng.exponential(5, 900), 2)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "event_id long, a double, b double, c double, label double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(df).drop("a", "b", "c")


def store(rows, bins=255):
    base = rows.select("features", F.col("label").alias("_y"), F.lit(1.0).alias("_w"), F.xxhash64("event_id").alias("_row"), F.lit(False).alias("_held"))
    return BinnedRows.store(base, feature_edges(base, bins))


def test_bins_hold_their_values(rows):
    kept = store(rows, bins=16)
    assert [len(e) for e in kept.edges][1] == 5 and all(len(e) <= 15 for e in kept.edges)
    x = np.array([r["features"].toArray() for r in rows.collect()])
    counts = kept.fold(lambda b: np.stack([np.bincount(c, minlength=17) for c in b.bins]), np.add)
    for i, edges in enumerate(kept.edges):
        assert counts[i].tolist() == np.bincount(np.searchsorted(edges, x[:, i]), minlength=17).tolist()
    assert counts.sum() == 3 * 900 and counts[0].max() < 900 / 8


@pytest.mark.parametrize("tau", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_quantiles_of_groups(rows, tau, monkeypatch):
    from pulsegrid.models import binned

    y = np.array([r["label"] for r in rows.collect()])

    def of(block):
        return (block.y * 100).astype(np.int64) % 4, block.y - 20.0, 1.0 + (block.y > 15)

    group, value, weight = (np.round(y * 100, 6)).astype(np.int64) % 4, y - 20.0, 1.0 + (y > 15)
    group = (y * 100).astype(np.int64) % 4
    expected = []
    for g in range(5):
        order = np.argsort(value[group == g], kind="stable")
        v, w = value[group == g][order], weight[group == g][order]
        expected.append(float(v[np.searchsorted(np.cumsum(w), w.sum() * tau * (1 - 1e-12))]) if len(v) else None)
    kept = store(rows)
    assert group_quantiles(kept, 5, of, tau) == expected
    monkeypatch.setattr(binned, "_LISTED", 0)  # every digit by a pass of its own
    assert group_quantiles(kept, 5, of, tau) == expected


def plain_boosting(x, y, edges, rounds, step, leaves, min_leaf, tau):
    """Quantile boosting with the plain tree; scores of all rows."""
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)])
    quantile = lambda v: np.sort(v)[np.searchsorted(np.arange(1, len(v) + 1), len(v) * tau * (1 - 1e-12))]
    score = np.full(len(y), quantile(y))
    for _ in range(rounds):
        pull = np.where(y > score, tau, tau - 1)
        for at in plain_tree(bins, pull, np.ones(len(y)), Limits(leaves=leaves, min_leaf=min_leaf)):
            score[list(at)] += step * quantile((y - score)[list(at)])
    return score


def test_fit_equals_plain_boosting(rows):
    data = rows.orderBy("event_id").collect()
    x, y = np.array([r["features"].toArray() for r in data]), np.array([r["label"] for r in data])
    edges = feature_edges(rows, 12)
    model = BoostedTrees(loss="quantile", tau=0.8, rounds=3, step=0.3, leaves=6, bins=12, checkpoint_every=2).fit(rows)
    found = [r["yhat"] for r in model.transform(rows).orderBy("event_id").collect()]
    assert found == pytest.approx(plain_boosting(x, y, edges, 3, 0.3, 6, 20, 0.8), abs=1e-9)


def test_layout_does_not_matter(rows):
    settings = dict(loss="quantile", tau=0.8, rounds=3, step=0.3, leaves=6, bins=64, row_share=0.7, valid_share=0.1)
    few, many = (BoostedTrees(**settings).fit(rows.repartition(n)) for n in (1, 7))
    assert few.trees == many.trees


def test_an_ended_fit_goes_on(rows, tmp_path, monkeypatch):
    settings = dict(loss="poisson", step=0.2, leaves=7, checkpoint_every=2, row_share=0.8, column_share=0.7, valid_share=0.1)
    whole = BoostedTrees(rounds=7, **settings).fit(rows)
    kept = str(tmp_path / "fit")
    short = BoostedTrees(rounds=5, resume_dir=kept, **settings).fit(rows)
    assert short.trees == whole.trees[:5]
    from pulsegrid.models import boosting

    grown = []
    grow = growth.grow
    monkeypatch.setattr(boosting.growth, "grow", lambda *a, **k: grown.append(1) or grow(*a, **k))
    longer = BoostedTrees(rounds=7, resume_dir=kept, **settings).fit(rows)
    assert longer.trees == whole.trees and longer.start == whole.start and len(grown) == 3  # rounds 5 to 7
    other = BoostedTrees(rounds=2, resume_dir=kept, **{**settings, "step": 0.1}).fit(rows)
    assert other.trees[0] != whole.trees[0] or other.step != whole.step


def test_large_ensembles_are_one_step(spark, rows):
    """2,500 trees: the plan has as many steps as for one."""
    trees = BoostedTrees(loss="squared", rounds=2, leaves=8, min_leaf=5).fit(rows).trees
    long, short = (ensemble.tree_sum(spark, trees * n, 0.01) for n in (1250, 1))
    plans = [m.transform(rows)._jdf.queryExecution().optimizedPlan().toString() for m in (long, short)]
    assert plans[0].count("\n") == plans[1].count("\n") and len(plans[0]) < 2 * len(plans[1])
    sums = [[r[ensemble.SCORE] for r in m.transform(rows).orderBy("event_id").collect()] for m in (long, short)]
    assert np.array(sums[0]) == pytest.approx(1250 * np.array(sums[1]), rel=1e-9)


def test_saved_model_scores_the_same(spark, rows, tmp_path):
    model = BoostedTrees(loss="pseudo_huber", rounds=3, depth=3, leaves=None, l2=1.0, min_curvature=2.0).fit(rows)
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.trees == model.trees
    take = lambda m: [r["yhat"] for r in m.transform(rows).orderBy("event_id").collect()]
    assert take(again) == take(model)


def test_large_sums_reach_the_driver_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_FEW_BYTES", 1000)
    numbered = spark.sparkContext.parallelize([(i, np.arange(600.0) * i) for i in range(24)], 12)
    received = []
    collect = RDD.collect

    def watched(rdd):
        found = collect(rdd)
        received.append(sum(v.nbytes for _, v in found))
        return found

    monkeypatch.setattr(RDD, "collect", watched)
    total = blocks.fold_blocks(numbered, 12, lambda v: v.copy(), blocks.add_to, blocks.array_pieces((20, 30)))
    assert np.array_equal(total, (np.arange(600.0) * sum(range(24))).reshape(20, 30))
    assert received == [total.nbytes]


def test_codes_are_summed_in_pieces():
    rng = np.random.default_rng(4)

    def part():
        codes = np.unique(rng.integers(0, 50, 30).astype(np.uint64))
        listed = (rng.integers(0, 3, 9), rng.integers(0, 1 << 40, 9).astype(np.uint64), rng.uniform(size=9))
        return (codes, rng.uniform(size=len(codes)), np.ones(len(codes))), listed

    def add(a, b):
        return binned._add_codes(a[0], b[0]), tuple(np.concatenate(p) for p in zip(a[1], b[1]))

    one, two = part(), part()
    whole = add(one, two)
    pieces = [add(a, b) for a, b in zip(binned._cut_codes(one, 7), binned._cut_codes(two, 7))]
    summed, listed = binned._join_codes(pieces)
    assert all(np.array_equal(a, b) for a, b in zip(summed, whole[0]))
    assert sorted(zip(*listed)) == sorted(zip(*whole[1]))
