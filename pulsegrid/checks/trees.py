"""Queries: tree models on one input with two values, where every fit has a closed form in SQL.

A tree has one possible split then, so a boosted model is, per group, a start value and a known step per round: towards
the group's quantile, or by the ratio of summed gradients and curvatures. Settings are the registry's own; only the
number of rounds is stated, and that the forest takes every row once. All rows of the signal take part.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.checks.common import check, rounded, sql_round
from pulsegrid.checks.forecasts import SPLIT_SIGNAL, split_signal
from pulsegrid.models.registry import make_model

ROUNDS = 2
_SLACK = "(1 - 1e-12::DOUBLE)"

XY = f"""{SPLIT_SIGNAL},
xy AS (SELECT event_id, user_id, ts, split, CASE WHEN steps >= 40 THEN 1 ELSE 0 END AS x, steps_t AS y FROM base)"""


def two_valued(spark: SparkSession, sf: str) -> DataFrame:
    """The signal with its split and one input: 1 for 40 steps or more, else 0, so that every split pays."""
    rows = split_signal(spark, sf, lagged=False).withColumns(
        {"x": F.when(F.col("steps") >= 40, 1.0).otherwise(0.0), "label": F.col("steps_t")}
    )
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)


def _fit(name: str, options: dict, spark: SparkSession, sf: str) -> DataFrame:
    frame = two_valued(spark, sf)
    model = make_model(name, **options).fit(frame.where(F.col("split") == "train"))
    return model.transform(frame).select("event_id", "split", rounded("yhat", 4).alias("yhat"))


# ---------------------------------------------------------------- closed forms

BAND = "CASE WHEN y BETWEEN 80 AND 400 THEN 1 + 0.5::DOUBLE * (y - 80) / 320 ELSE 1 END"
PEAK = "1 + least(abs(y) / 200.0::DOUBLE, 3)"


def weighted_quantile(by: str, tau: float, weight: str = "1", rows: str = "xy WHERE split = 'train'") -> str:
    """First value at which ``tau`` of the weight is reached, per group."""
    part = f"PARTITION BY {by}"
    return f"""SELECT {by}, min(y) AS q FROM (
      SELECT {by}, y, sum(w) OVER ({part} ORDER BY y) AS up, sum(w) OVER ({part}) AS whole
      FROM (SELECT *, CAST({weight} AS DOUBLE) AS w FROM {rows}))
    WHERE up >= whole * {tau}::DOUBLE * {_SLACK} GROUP BY {by}"""


def towards_quantile(name: str, tau: float, step: float, weight: str = "1", rounds: int = ROUNDS, rows: str = "xy WHERE split = 'train'") -> str:
    """``name``(x, yhat): each round goes a step of the way from the start value to the group's quantile."""
    left = (1 - step) ** rounds
    whole = weighted_quantile("one", tau, weight, f"(SELECT *, 1 AS one FROM {rows})")
    return f"""{name}_groups AS ({weighted_quantile("x", tau, weight, rows)}), {name}_whole AS ({whole}),
{name} AS (SELECT x, g.q + (h.q - g.q) * {left!r}::DOUBLE AS yhat FROM {name}_groups g, {name}_whole h)"""


def by_gradient(name: str, label: str, start: str, gradient: str, curvature: str, l2: float, step: float, result: str) -> str:
    """``name``(x, yhat): each round adds a step of sum(gradient) / (sum(curvature) + l2)."""
    parts = [
        f"{name}_rows AS (SELECT x, {label} AS y FROM xy WHERE split = 'train')",
        f"{name}0 AS (SELECT DISTINCT x, (SELECT {start} FROM {name}_rows) AS f FROM {name}_rows)",
    ]
    for k in range(ROUNDS):
        parts.append(
            f"{name}{k + 1} AS (SELECT x, any_value(f) + {step}::DOUBLE * sum({gradient}) / (sum({curvature}) + {l2}) AS f"
            f" FROM {name}_rows JOIN {name}{k} USING (x) GROUP BY x)"
        )
    return ", ".join([*parts, f"{name} AS (SELECT x, {result} AS yhat FROM {name}{ROUNDS})"])


def _query(*tables: str, value: str = "m.yhat") -> str:
    return f"WITH {XY}, {', '.join(tables)} SELECT event_id, split, {sql_round(value, 4)} AS yhat FROM xy JOIN m USING (x)"


_MEANS = "m AS (SELECT x, avg(y) AS yhat FROM xy WHERE split = 'train' GROUP BY x)"
_LOG_LABEL = "ln(1 + greatest(y, 0))"
_EXP = ("y - exp(f)", "exp(f)")
_HUBER = ("(y - f) / sqrt(1 + (y - f) * (y - f))", "1 / sqrt(1 + (y - f) * (y - f))")
_MIX = "m AS (SELECT x, {0} * a.yhat + {1} * b.yhat AS yhat FROM a JOIN b USING (x))"

# Fixed values in the SQL: quantile, step, penalty and weights of the registry's models.
TREES: dict[str, tuple[str, dict, str]] = {
    "tree_boost_l2": ("hgb_l2", {"maxIter": ROUNDS}, _query(_MEANS)),
    "tree_forest": ("rf100", {"trees": 4, "bootstrap": False}, _query(_MEANS)),
    "tree_boost_absolute": ("hgb_mae", {"rounds": ROUNDS}, _query(towards_quantile("m", 0.5, 0.06, BAND))),
    "tree_boost_quantile": ("hgb_q80", {"rounds": ROUNDS}, _query(towards_quantile("m", 0.8, 0.06))),
    "tree_boost_column_share": ("lgbm_q80", {"rounds": ROUNDS}, _query(towards_quantile("m", 0.8, 0.05))),
    "tree_boost_deep": ("cat_q80", {"rounds": ROUNDS}, _query(towards_quantile("m", 0.8, 0.05))),
    "tree_boost_deep_absolute": ("cat_mae", {"rounds": ROUNDS}, _query(towards_quantile("m", 0.5, 0.05))),
    "tree_boost_poisson": (
        "hgb_poisson_log1p",
        {"rounds": ROUNDS},
        _query(by_gradient("m", _LOG_LABEL, "ln(avg(y))", *_EXP, 0.0, 0.06, "greatest(exp(exp(f)) - 1, 0)")),
    ),
    "tree_boost_poisson_share": (
        "lgbm_poisson_log1p",
        {"rounds": ROUNDS},
        _query(by_gradient("m", _LOG_LABEL, "ln(avg(y))", *_EXP, 1.0, 0.04, "greatest(exp(exp(f)) - 1, 0)")),
    ),
    "tree_boost_poisson_rate": (
        "xgb_poisson",
        {"rounds": ROUNDS},
        _query(by_gradient("m", "y", "ln(avg(y))", *_EXP, 1.0, 0.05, "exp(f)")),
    ),
    "tree_boost_pseudo_huber": (
        "xgb_huber",
        {"rounds": ROUNDS},
        _query(
            by_gradient(
                "m", "y", "min(y) FILTER (y >= (SELECT q FROM middle))", *_HUBER, 1.0, 0.05, "f"
            ).replace("m_rows AS", f"middle AS ({weighted_quantile('one', 0.5, '1', '(SELECT *, 1 AS one FROM xy WHERE split = ' + chr(39) + 'train' + chr(39) + ')')}), m_rows AS", 1)
        ),
    ),
    "tree_blend": (
        "hgb_mae_blend",
        {"rounds": ROUNDS},
        _query(towards_quantile("a", 0.5, 0.06), towards_quantile("b", 0.5, 0.06, PEAK), _MIX.format(0.5, 0.5)),
    ),
    "tree_quantile_blend": (
        "hgb_mae_qblend",
        {"rounds": ROUNDS},
        _query(towards_quantile("a", 0.5, 0.06), towards_quantile("b", 0.8, 0.06), _MIX.format(0.75, 0.25)),
    ),
}
for _name, (_model, _options, _sql) in TREES.items():
    check(_name, _sql)(partial(_fit, _model, _options))


# Active rows all have the input 1, so their size is one number. The classifier's rounds: labels -1 and 1, weight 3 for active rows, gradient of the logistic loss on twice the score.
_ACTIVE_SIZE = towards_quantile("size", 0.5, 0.06, rows="xy WHERE split = 'train' AND y >= 50")
_STAGES = [
    "labelled AS (SELECT x, CASE WHEN y >= 50 THEN 1 ELSE -1 END AS s, CASE WHEN y >= 50 THEN 3.0::DOUBLE ELSE 1 END AS w"
    " FROM xy WHERE split = 'train')",
    "c1 AS (SELECT x, sum(w * s) / sum(w) AS f FROM labelled GROUP BY x)",
    "c2 AS (SELECT x, any_value(f) + 0.1::DOUBLE * sum(w * 4 * s / (1 + exp(2 * s * f))) / sum(w) AS f"
    " FROM labelled JOIN c1 USING (x) GROUP BY x)",
]
check(
    "tree_two_stage",
    _query(_ACTIVE_SIZE, *_STAGES, "m AS (SELECT x, (SELECT max(yhat) FROM size) / (1 + exp(-2 * f)) AS yhat FROM c2)"),
)(partial(_fit, "two_stage_hgb", {"rounds": ROUNDS, "regressor": {"rounds": ROUNDS}}))


# ---------------------------------------------------------------- chosen models

_GRID = {"learning_rate": [0.1, 0.3], "max_iter": [1, 2], "min_samples_leaf": [50], "max_depth": [None]}
_FOLDS = 2


def _grid_sql() -> str:
    """Errors of every combination over the expanding folds of the train rows in time order."""
    pieces = []
    for step in _GRID["learning_rate"]:
        for rounds in _GRID["max_iter"]:
            tables, errors = [], []
            for j in range(_FOLDS):
                name = f"p{str(step).replace('.', '')}_{rounds}_{j}"
                start = f"(SELECT n - {_FOLDS - j} * size FROM cut)"
                rows = f"ordered WHERE i < {start}"
                tables.append(towards_quantile(name, 0.8, step, rounds=rounds, rows=rows))
                errors.append(
                    f"(SELECT avg(abs(y - yhat)) FROM ordered JOIN {name} USING (x)"
                    f" WHERE i >= {start} AND i < {start} + (SELECT size FROM cut))"
                )
            pieces.append((tables, f"SELECT {step}::DOUBLE AS learning_rate, {rounds}::DOUBLE AS max_iter, "
                           f"{sql_round('(' + ' + '.join(errors) + f') / {_FOLDS}', 4)} AS cv_mae"))  # fmt: skip
    ctes = ", ".join(t for tables, _ in pieces for t in tables)
    return f"""WITH {XY},
ordered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, user_id) - 1 AS i FROM xy WHERE split = 'train'),
cut AS (SELECT count(*) AS n, count(*) // {_FOLDS + 1} AS size FROM ordered), {ctes}
{' UNION ALL '.join(select for _, select in pieces)}"""


@check("tree_grid_search", _grid_sql())
def tree_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Grid search without early stopping: its errors follow from group quantiles of each fold."""
    search = make_model("hgb_q80_auto", grid=_GRID, folds=_FOLDS, valid_share=0.0, prune=False)
    search.fit(two_valued(spark, sf).where(F.col("split") == "train"))
    return search.result_table(spark).select("learning_rate", "max_iter", rounded("cv_mae", 4).alias("cv_mae"))


def _tolerance_sql() -> str:
    """Both bases on the last of three folds choose alpha; then they are fitted on all train rows."""
    alphas = "[0.0, 0.25, 0.5, 0.65, 0.75, 0.85, 1.0]"
    start = "(SELECT n - size FROM cut)"
    rows = f"ordered WHERE i < {start}"
    return f"""WITH {XY},
ordered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, user_id) - 1 AS i FROM xy WHERE split = 'train'),
cut AS (SELECT count(*) AS n, count(*) // 4 AS size FROM ordered),
{towards_quantile("a", 0.5, 0.05, rows=rows)}, {towards_quantile("b", 0.8, 0.06, rows=rows)},
judged AS (SELECT y, a.yhat AS p0, b.yhat AS p1 FROM ordered JOIN a USING (x) JOIN b USING (x) WHERE i >= {start}),
tried AS (SELECT alpha, k, (SELECT avg(CASE WHEN abs(y - (alpha * p0 + (1 - alpha) * p1)) <= 50 THEN 1.0::DOUBLE
          ELSE 0 END) FROM judged) AS hits
          FROM (SELECT unnest({alphas})::DOUBLE AS alpha, unnest(range(7)) AS k)),
chosen AS (SELECT alpha FROM tried ORDER BY hits DESC, k LIMIT 1),
{towards_quantile("c", 0.5, 0.05)}, {towards_quantile("d", 0.8, 0.06)},
m AS (SELECT x, alpha * c.yhat + (1 - alpha) * d.yhat AS yhat FROM c JOIN d USING (x), chosen)
SELECT event_id, split, {sql_round('m.yhat', 4)} AS yhat FROM xy JOIN m USING (x)"""


check("tree_tolerance_blend", _tolerance_sql())(
    partial(_fit, "ensemble_tol", {"bases": {"cat_mae": {"rounds": ROUNDS}, "hgb_q80": {"rounds": ROUNDS}}})
)
