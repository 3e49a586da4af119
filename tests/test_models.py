from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pulsegrid.models import registry
from pulsegrid.models.binned import BinnedRows
from pulsegrid.models.boosting import BoostedTrees
from pulsegrid.models.composite import Blend, BlendModel, TwoStage
from pulsegrid.models.losses import make_loss
from pulsegrid.models.search import GridSearchedTrees, ToleranceBlend, best_alpha, blend_accuracies, combinations, DEFAULT_GRID
from pulsegrid.models.store import load_model, save_model


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 3)) * [1.0, 5.0, 0.2]
    y = 20 + x @ np.array([3.0, -2.0, 10.0]) + rng.exponential(10, 800)
    return x, np.maximum(y, 0)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(i % 5, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, a double, b double, c double, label double")
    df = df.withColumn("ts", F.timestamp_add("MINUTE", F.col("event_id"), F.lit("2024-01-01").cast("timestamp_ntz")))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).drop("a", "b", "c").cache()


def predict(model, df):
    rows = model.transform(df).select("event_id", "yhat").orderBy("event_id").collect()
    return np.array([r["yhat"] for r in rows])


def design(x):
    return np.column_stack([np.ones(len(x)), x])


def ridge_line(x, y, alpha):
    penalty = np.diag([0.0, *[alpha] * x.shape[1]])
    w = np.linalg.solve(design(x).T @ design(x) + penalty, design(x).T @ y)
    return design(x) @ w


def test_linear_regression_is_least_squares(data, frame):
    assert predict(registry.make_model("linreg").fit(frame), frame) == pytest.approx(ridge_line(*data, 0.0), abs=1e-4)


@pytest.mark.parametrize("alpha", [1.0, 500.0])
def test_ridge_has_the_stated_penalty(data, frame, alpha):
    model = registry.make_model("ridge", alpha=alpha, tol=1e-10).fit(frame)
    assert predict(model, frame) == pytest.approx(ridge_line(*data, alpha), abs=1e-3)


def test_penalty_per_row(data, frame):
    model = registry.make_model("ridge_sgd", alpha=0.5, max_iter=200, tol=1e-10).fit(frame)
    assert predict(model, frame) == pytest.approx(ridge_line(*data, 0.5 * len(data[1])), abs=1e-3)


def huber_gradient(x, y, model, alpha):
    r = (y - model.intercept - x @ model.coefficients.toArray()) / model.scale
    inside = np.abs(r) <= 1.35
    slope = np.where(inside, 2 * r, 2 * 1.35 * np.sign(r))
    line = -(x.T @ slope) + 2 * alpha * model.coefficients.toArray()
    return np.array([*line, slope.sum(), len(y) - (r[inside] ** 2).sum() - 1.35**2 * (~inside).sum()])


@pytest.mark.parametrize("alpha", [1e-4, 50.0])
def test_huber_solution_has_no_gradient(data, frame, alpha):
    model = registry.make_model("huber", alpha=alpha).fit(frame)
    assert np.abs(huber_gradient(*data, model, alpha)).max() < 1e-6 * len(data[1])


def test_huber_shrugs_off_outliers(data, frame):
    x, y = data
    wild = frame.withColumn("label", F.when(F.col("event_id") % 20 == 0, F.col("label") + 5000).otherwise(F.col("label")))
    far = np.abs(predict(registry.make_model("huber").fit(wild), frame) - predict(registry.make_model("huber").fit(frame), frame))
    assert far.max() < 8 < np.abs(predict(registry.make_model("linreg").fit(wild), frame) - y).mean()


def test_stochastic_descent_stops_early_and_lowers_the_loss(frame):
    estimator = registry.make_model("ridge_sgd")
    estimator.fit(frame)
    assert len(estimator.losses) < 20 and estimator.losses[-1] < 0.8 * estimator.losses[0]


LOSS_SETTINGS = [("squared", 0.5), ("absolute", 0.5), ("quantile", 0.8), ("poisson", 0.5), ("pseudo_huber", 0.5)]


@pytest.mark.parametrize("loss,tau", LOSS_SETTINGS)
def test_boosting_lowers_its_own_loss_every_few_rounds(frame, loss, tau):
    model = BoostedTrees(loss=loss, tau=tau, rounds=4, step=0.3, depth=3, min_leaf=5, checkpoint_every=2).fit(frame)
    own = make_loss(loss, tau)

    def error(rounds):
        f = F.log("yhat") if loss == "poisson" else F.col("yhat")
        return model.truncated(rounds).transform(frame).agg(F.avg(own.value(F.col("label"), f))).first()[0]

    errors = [error(r) for r in (0, 2, 4)]
    assert errors[0] > errors[1] > errors[2]


def test_quantile_coverage(frame):
    model = BoostedTrees(loss="quantile", tau=0.8, rounds=5, step=0.5, depth=3, min_leaf=10).fit(frame)
    covered = model.transform(frame).agg(F.avg((F.col("label") <= F.col("yhat")).cast("double"))).first()[0]
    assert covered == pytest.approx(0.8, abs=0.04)


def test_shorter_fit_is_the_beginning_of_a_longer_one(frame):
    settings = dict(loss="quantile", tau=0.8, step=0.3, depth=3, min_leaf=5, row_share=0.8, column_share=0.7)
    long, short = BoostedTrees(rounds=3, **settings).fit(frame), BoostedTrees(rounds=2, **settings).fit(frame)
    assert predict(long.truncated(2), frame) == pytest.approx(predict(short, frame), rel=1e-9)


def test_early_stopping(frame):
    noise = frame.withColumn("label", F.pmod(F.xxhash64("event_id"), F.lit(100)).cast("double"))
    model = BoostedTrees(loss="squared", rounds=12, step=1.0, depth=5, min_leaf=2, valid_share=0.3, patience=2).fit(noise)
    assert model.rounds < 12


def test_log_target_is_never_negative(frame):
    model = BoostedTrees(loss="poisson", rounds=2, log_target=True, min_leaf=5).fit(frame)
    assert predict(model, frame).min() >= 0


def test_weights_move_the_fit(frame):
    plain = BoostedTrees(loss="absolute", rounds=1, min_leaf=5).fit(frame)
    heavy = BoostedTrees(loss="absolute", rounds=1, min_leaf=5, weigh=lambda y: F.when(y > 40, 20.0).otherwise(1.0)).fit(frame)
    assert heavy.start > plain.start + 5


def test_two_stage(frame):
    size = BoostedTrees(loss="absolute", rounds=2, min_leaf=5)
    model = TwoStage(size, threshold=30, rounds=2, depth=3, min_leaf=5).fit(frame)
    assert predict(model, frame).min() >= 0
    never = TwoStage(BoostedTrees(loss="absolute", rounds=1, min_leaf=5), threshold=1e9, rounds=2, depth=2, min_leaf=5)
    quiet = predict(never.fit(frame), frame)
    assert np.isfinite(quiet).all() and quiet.max() < predict(model, frame).max()


class Constant(Estimator):
    def __init__(self, value):
        super().__init__()
        self.value = value

    def _fit(self, df):
        return BoostedTrees(loss="squared", rounds=0).fit(df.withColumn("label", F.lit(float(self.value))))


def test_blend_of_constants(frame):
    model = Blend([Constant(10), Constant(20)], [0.75, 0.25]).fit(frame)
    assert isinstance(model, BlendModel) and set(predict(model, frame)) == {12.5}


def test_tolerance_blend_finds_the_best_share(frame):
    flat = frame.withColumn("label", F.lit(13.0))
    search = ToleranceBlend([lambda: Constant(10), lambda: Constant(20)], k=1, alphas=[0.0, 0.5, 0.7, 0.75, 1.0])
    model = search.fit(flat)
    assert model.weights == pytest.approx([0.7, 0.3])
    assert dict(search.accuracies)[0.7] >= max(a for _, a in search.accuracies)


def test_three_bases_get_equal_weights(frame):
    model = ToleranceBlend([lambda v=v: Constant(v) for v in (1, 2, 6)]).fit(frame)
    assert model.weights == pytest.approx([1 / 3] * 3) and set(np.round(predict(model, frame), 9)) == {3.0}


def test_first_best_alpha_wins():
    assert best_alpha([(0.0, 0.2), (0.5, 0.4), (1.0, 0.4)]) == 0.5
    assert best_alpha([(0.3, None), (0.5, None)]) == 0.3


def test_blend_accuracies(spark):
    df = spark.createDataFrame([(10.0, 0.0, 20.0), (10.0, 10.0, 0.0)], "y double, yhat0 double, yhat1 double")
    found = {r["alpha"]: r["accuracy"] for r in blend_accuracies(df, [0.0, 0.5, 1.0], 1).collect()}
    assert found == {0.0: 0.0, 0.5: 0.5, 1.0: 0.5}


def test_grid_search(spark, frame):
    grid = {"learning_rate": [0.5, 0.1], "max_iter": [1, 2], "min_samples_leaf": [10], "max_depth": [2]}
    search = GridSearchedTrees(grid, folds=2, valid_share=0.0)
    model = search.fit(frame)
    table = search.result_table(spark).collect()
    assert len(table) == 4 and min(r["cv_mae"] for r in table) == pytest.approx(
        next(r["cv_mae"] for r in search.results if {k: r[k] for k in grid} == search.best)
    )
    assert model.rounds == search.best["max_iter"]
    assert len(combinations(DEFAULT_GRID)) == 81


def test_concurrent_search_equals_one_after_the_other(frame):
    grid = {"learning_rate": [0.5, 0.02, 0.3], "max_iter": [1, 3], "min_samples_leaf": [10, 40]}
    one, many = (GridSearchedTrees(grid, folds=3, workers=n) for n in (1, 5))
    first, second = one.fit(frame), many.fit(frame)
    assert one.results == many.results and one.best == many.best and first.trees == second.trees
    assert any(r["n_folds"] < 3 for r in one.results)  # pruning has stopped some
    assert one.fits <= many.fits <= 3 * 3 * 2


@pytest.mark.parametrize("name", ["linreg", "huber", "ridge_sgd", "hgb_l2", "hgb_q80", "lgbm_poisson_log1p", "hgb_mae_qblend", "two_stage_hgb"])
def test_saved_models_predict_the_same(spark, frame, tmp_path, name):
    options = {"hgb_l2": {"maxIter": 2}, "two_stage_hgb": {"rounds": 1, "regressor": {"rounds": 1}}}
    default = {} if name in ("linreg", "huber", "ridge_sgd") else {"rounds": 1}
    model = registry.make_model(name, **options.get(name, default)).fit(frame)
    save_model(spark, model, str(tmp_path / name))
    again = load_model(spark, str(tmp_path / name))
    assert predict(again, frame) == pytest.approx(predict(model, frame))


def test_registry(frame):
    with pytest.raises(ValueError):
        registry.make_model("no_such_model")
    registry.register_model("Always_Seven", lambda seed: Constant(7))
    assert set(predict(registry.make_model("always_seven").fit(frame), frame)) == {7.0}
    for name in registry.model_names():
        if name not in registry.UNFITTED:
            assert isinstance(registry.make_model(name), Estimator)


def test_unknown_loss():
    with pytest.raises(ValueError):
        make_loss("cosine")


def test_huber_needs_few_passes(frame):
    estimator = registry.make_model("huber")
    estimator.fit(frame)
    assert estimator.steps <= 12  # by reweighting alone more than twenty


def test_blended_models_share_the_binned_rows(frame, monkeypatch):
    stored = []
    store = BinnedRows.store

    def watched(rows, edges, *more):
        stored.append(rows)
        return store(rows, edges, *more)

    first = BoostedTrees(loss="absolute", rounds=2, min_leaf=10, valid_share=0.1)
    second = BoostedTrees(loss="squared", rounds=2, min_leaf=10, valid_share=0.1, weigh=lambda y: 1 + y / 10)
    apart = [predict(part.fit(frame), frame) for part in (first, second)]
    monkeypatch.setattr(BinnedRows, "store", watched)
    model = Blend([first, second], [0.5, 0.25]).fit(frame)
    assert len(stored) == 1
    assert predict(model, frame) == pytest.approx(0.5 * apart[0] + 0.25 * apart[1])


def test_like_fits_of_a_search_share_their_passes(frame, monkeypatch):
    passes = []
    fold = BinnedRows.fold

    def watched(rows, *how):
        passes.append(rows)
        return fold(rows, *how)

    monkeypatch.setattr(BinnedRows, "fold", watched)
    one, three = (
        GridSearchedTrees({"min_samples_leaf": leaf, "max_iter": [2], "max_depth": [2]}, folds=2, workers=1, valid_share=0.0, prune=False)
        for leaf in ([1], [1, 2, 3])
    )
    one.fit(frame)
    alone, passes[:] = len(passes), []
    three.fit(frame)
    assert len(passes) <= alone + 4
    assert len({r["cv_mae"] for r in three.results}) == 1 and three.fits == 6
