"""Model factory by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import GBTRegressor, LinearRegression

from pulsegrid.functions.weights import band_weight, power_weight
from pulsegrid.models.boosting import BoostedTrees
from pulsegrid.models.composite import Blend, TwoStage
from pulsegrid.models.forest import RandomForest
from pulsegrid.models.linear import HuberRegression, RidgeRegression, StochasticRidge
from pulsegrid.models.search import GridSearchedTrees, ToleranceBlend
from pulsegrid.operators.baselines import CALENDAR_BASELINES

Maker = Callable[..., Estimator]

# Names that predict without fitting.
UNFITTED = ("naive_last", *CALENDAR_BASELINES)

# Model names and their default settings. Leaves default to 31, depth to none, rows of a leaf to 20.
_BOOSTED = {
    "hgb_mae": dict(loss="absolute", rounds=400, step=0.06, weigh=lambda y: band_weight(y, 80, 400, 1.5)),
    "hgb_q80": dict(loss="quantile", tau=0.8, rounds=600, step=0.06, min_leaf=100),
    "hgb_poisson_log1p": dict(loss="poisson", rounds=400, step=0.06, log_target=True),
    "lgbm_q80": dict(
        loss="quantile", tau=0.8, rounds=1200, step=0.05, leaves=63, min_leaf=80, l2=1.0, column_share=0.8
    ),
    "lgbm_poisson_log1p": dict(
        loss="poisson", rounds=1800, step=0.04, leaves=127, min_leaf=40, l2=1.0, column_share=0.8, log_target=True
    ),
    "cat_q80": dict(loss="quantile", tau=0.8, rounds=2500, step=0.05, leaves=None, depth=8, min_leaf=1, l2=7.0, row_share=0.9),
    "cat_mae": dict(loss="absolute", rounds=2500, step=0.05, leaves=None, depth=8, min_leaf=1, l2=7.0, row_share=0.9),
    "xgb_poisson": dict(
        loss="poisson", rounds=1500, step=0.05, leaves=None, depth=8, min_leaf=1, min_curvature=1.0, l2=1.0,
        row_share=0.8, column_share=0.8,
    ),
    "xgb_huber": dict(
        loss="pseudo_huber", rounds=2000, step=0.05, leaves=None, depth=8, min_leaf=1, min_curvature=4.0, l2=1.0,
        row_share=0.8, column_share=0.8,
    ),
}
# Settings of the blended and two-stage models.
_PLAIN_MAE = dict(loss="absolute", rounds=400, step=0.06, min_leaf=100)


def _linreg(seed: int, **settings) -> Estimator:
    scaler = StandardScaler(withMean=False, withStd=True, inputCol="features", outputCol="scaled")
    # One solver for any number of inputs.
    defaults = dict(solver="l-bfgs", maxIter=1000, tol=1e-12)
    regression = LinearRegression(
        featuresCol="scaled", labelCol="label", predictionCol="yhat", **{**defaults, **settings}
    )
    return Pipeline(stages=[scaler, regression])


def _forest(trees: int) -> Maker:
    return lambda seed, **settings: RandomForest(**{"trees": trees, "seed": seed, **settings})


def _boosted(name: str) -> Maker:
    return lambda seed, **settings: BoostedTrees(**{**_BOOSTED[name], "seed": seed, **settings})


def _hgb_l2(seed: int, **settings) -> Estimator:
    defaults = dict(maxIter=300, stepSize=0.06, maxDepth=5, maxBins=255, minInstancesPerNode=20, seed=seed)
    return GBTRegressor(labelCol="label", predictionCol="yhat", lossType="squared", **{**defaults, **settings})


def _peak_blend(seed: int, alpha: float = 0.5, k: float = 200.0, power: float = 1.0, cap: float = 3.0, **settings) -> Estimator:
    base = {**_PLAIN_MAE, "seed": seed, **settings}
    peak = {**base, "weigh": lambda y: power_weight(y, k, power, cap)}
    return Blend([BoostedTrees(**base), BoostedTrees(**peak)], [alpha, 1.0 - alpha])


def _quantile_blend(seed: int, alpha: float = 0.75, q: float = 0.8, **settings) -> Estimator:
    middle = {**_PLAIN_MAE, "seed": seed, **settings}
    upper = {**_PLAIN_MAE, "loss": "quantile", "tau": q, "rounds": 600, "seed": seed, **settings}
    return Blend([BoostedTrees(**middle), BoostedTrees(**upper)], [alpha, 1.0 - alpha])


def _two_stage(seed: int, regressor: dict | None = None, **settings) -> Estimator:
    size = BoostedTrees(**{**_PLAIN_MAE, "seed": seed, **(regressor or {})})
    return TwoStage(size, **{"threshold": 50, "active_row_weight": 3.0, "seed": seed, **settings})


def _grid(prune: bool) -> Maker:
    return lambda seed, **settings: GridSearchedTrees(**{"folds": 5, "prune": prune, "seed": seed, **settings})


def _tolerance_blend(seed: int, bases: dict[str, dict] | None = None, **settings) -> Estimator:
    chosen = bases or {"lgbm_poisson_log1p": {}, "hgb_q80_auto_fast": {}}
    makers = [lambda n=n, s=s: make_model(n, seed, **s) for n, s in chosen.items()]
    defaults = dict(k=50, folds=3, alphas=[0.0, 0.25, 0.5, 0.65, 0.75, 0.85, 1.0])
    return ToleranceBlend(makers, **{**defaults, **settings})


_MAKERS: dict[str, Maker] = {
    "linreg": _linreg,
    "ridge": lambda seed, **s: RidgeRegression(**{"alpha": 1.0, **s}),
    "ridge_sgd": lambda seed, **s: StochasticRidge(**{"alpha": 1e-4, "max_iter": 20, "seed": seed, **s}),
    "huber": lambda seed, **s: HuberRegression(**s),
    "rf100": _forest(100),
    "rf200": _forest(200),
    "hgb_l2": _hgb_l2,
    **{name: _boosted(name) for name in _BOOSTED},
    "hgb_mae_blend": _peak_blend,
    "hgb_mae_qblend": _quantile_blend,
    "two_stage_hgb": _two_stage,
    "hgb_q80_auto": _grid(prune=True),
    "hgb_q80_auto_v": _grid(prune=True),
    "hgb_q80_auto_fast": _grid(prune=False),
    "ensemble_tol": _tolerance_blend,
}


def model_names() -> list[str]:
    return [*UNFITTED, *_MAKERS]


def register_model(name: str, maker: Maker) -> None:
    """Add a model of one's own: ``maker(seed, **settings)`` returns an estimator that predicts ``yhat``."""
    _MAKERS[name.lower()] = maker


def make_model(name: str, seed: int = 42, **settings) -> Estimator:
    maker = _MAKERS.get(name.lower())
    if maker is None:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(model_names())}")
    return maker(seed, **settings)
