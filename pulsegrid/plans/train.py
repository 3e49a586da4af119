"""Train-and-compare job and the job that scores an earlier run again.

Layout of a run folder: ``settings`` (one row of JSON), ``models/<name>`` (saved models), ``scored`` (long table
of all forecasts, one partition per model), ``sketches`` (quantile sketches of the errors) and ``model_compare``
(leaderboard as CSV).
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.layout import Layout, layout_of
from pulsegrid.models.registry import UNFITTED, make_model
from pulsegrid.models.store import describe_model, load_model, save_model, saved_models
from pulsegrid.operators import baselines, examples, leaderboard, metrics, sketches
from pulsegrid.operators.encode import fill_missing, numeric_features
from pulsegrid.operators.filters import min_samples
from pulsegrid.operators.skew import HotKeys, find_hot_keys
from pulsegrid.operators.splits import split, split_counts
from pulsegrid.session import freeze
from pulsegrid.sources.sinks import append_results, write_csv, write_table

# Columns that are numeric but no inputs.
_NOT_FEATURES = ("ref_prev", "row_index")


@dataclass(frozen=True)
class RunSettings:
    run_id: str
    models: Mapping[str, Mapping] = field(default_factory=lambda: {"averaging": {}, "median": {}, "mode": {}})
    split_mode: str = "per_user_pct"
    split: Mapping = field(default_factory=dict)
    min_samples_per_user: int = 2
    task: str = "interval"
    horizon: int = 1
    tolerances: tuple[float, ...] = (100,)
    exclude: tuple[str, ...] = ()
    seed: int = 42
    note: str = ""


@dataclass(frozen=True)
class RunResult:
    board: DataFrame
    metrics: DataFrame
    scored: DataFrame
    counts: DataFrame


def chosen_inputs(features: DataFrame, settings: RunSettings, layout: Layout) -> list[str]:
    """Columns the models learn from: all numeric ones but the target, the current value and identifiers."""
    exclude = (*settings.exclude, *_NOT_FEATURES, *(() if layout.tie_is_input else layout.tie))
    return numeric_features(features, exclude=exclude)


def prepare(
    features: DataFrame, settings: RunSettings, layout: Layout | None = None, hot: HotKeys | None = None
) -> tuple[DataFrame, list[str]]:
    """Filter, split, choose and fill inputs, assemble. Stored once: every model and fold reads it."""
    layout = layout or layout_of(features.columns)
    hot = find_hot_keys(features, layout.key) if hot is None else hot
    rows = min_samples(features, settings.min_samples_per_user, layout, hot) if settings.min_samples_per_user else features
    rows = split(rows, settings.split_mode, layout, hot, **settings.split)
    rows = rows.where(F.col("split").isNotNull())
    inputs = chosen_inputs(rows, settings, layout)
    vectors = [c for c in (f"{layout.key}_vec",) if c in rows.columns]
    filled = fill_missing(rows.withColumns({f"_x_{c}": F.col(c) for c in inputs}), [f"_x_{c}" for c in inputs], as_float=True)
    assembler = VectorAssembler(inputCols=[*[f"_x_{c}" for c in inputs], *vectors], outputCol="features")
    lagged = _previous(rows)
    frame = assembler.transform(filled).select(
        *layout.full_order,
        "split",
        "features",
        F.col("steps_t").cast("double").alias("label"),
        F.col("steps_t"),
        *[F.col(c) for c in (*baselines.CELL, "steps") if c in rows.columns],
        (F.col(lagged).cast("double") if lagged else F.lit(None).cast("double")).alias("ref_prev"),
    )
    return freeze(frame), [*inputs, *vectors]


def _previous(features: DataFrame) -> str | None:
    """Column with the previous value, if there is one."""
    return next((c for c in ("ref_prev", "steps_lag1") if c in features.columns), None)


def forecast(
    frame: DataFrame,
    name: str,
    settings: RunSettings,
    run_dir: str | None = None,
    resume: bool = False,
    layout: Layout | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Frame with ``yhat`` from the named model; a saved model is loaded instead of fitted when resuming."""
    spark = frame.sparkSession
    layout = layout or layout_of(frame.columns)
    key = name.lower()
    if key == "naive_last":
        return baselines.naive_forecast(frame, "ref_prev")
    if key in UNFITTED:
        return baselines.calendar_forecast(frame, baselines.CALENDAR_BASELINES[key], layout=layout, counts=counts)
    path = f"{run_dir}/models/{name}" if run_dir else None
    if path and resume and describe_model(spark, path):
        return load_model(spark, path).transform(frame)
    options = dict(settings.models.get(name, {}))
    model: Model = make_model(name, settings.seed, **options).fit(frame.where(F.col("split") == "train"))
    if path:
        save_model(spark, model, path)
    return model.transform(frame)


def _narrow(predicted: DataFrame, name: str, layout: Layout) -> DataFrame:
    kept = [*layout.full_order, *(c for c in ("steps",) if c in predicted.columns)]
    return metrics.scored_columns(predicted, name, y="label", keep=kept)


def _board(scored: DataFrame, settings: RunSettings) -> tuple[DataFrame, DataFrame]:
    table = freeze(metrics.evaluate(scored, settings.tolerances))
    board = leaderboard.leaderboard(table.drop("n_scored", "n_missing"))
    described = board.withColumns(
        {
            "split_mode": F.lit(settings.split_mode),
            "task": F.lit(settings.task),
            "horizon": F.lit(settings.horizon),
            "run_id": F.lit(settings.run_id),
            "note": F.lit(settings.note),
        }
    )
    return table, described


# Columns of the table of all runs.
RESULT_COLUMNS = ("MAE_val", "RMSE_val", "MAPE_val", "R2_val", "MAE_test", "RMSE_test", "MAPE_test", "R2_test")


def train_and_compare(
    features: DataFrame,
    settings: RunSettings,
    run_dir: str | None = None,
    results: str | None = None,
    resume: bool = False,
    layout: Layout | None = None,
    features_path: str | None = None,
) -> RunResult:
    """Fit (or load) every model, score all splits in one grouped pass, rank.

    Forecasts are written model by model, to the run folder or to scratch space, so the scoring passes read
    narrow files instead of running all models again, and a failed run resumes where it stopped.
    """
    spark = features.sparkSession
    layout = layout or layout_of(features.columns)
    if "naive_last" in {m.lower() for m in settings.models} and _previous(features) is None:
        raise ValueError("the naive forecast needs the previous value; the feature job makes 'ref_prev'")
    frame, _ = prepare(features, settings, layout)
    if run_dir:
        if resume and features_path is None:
            features_path = load_settings(spark, run_dir, settings)[1]
        about = json.dumps({**asdict(settings), "features_path": features_path})
        write_table(spark.createDataFrame([(about,)], "settings string").coalesce(1), f"{run_dir}/settings")
    parts, counts = [], None
    if {m.lower() for m in settings.models} & {*baselines.CALENDAR_BASELINES}:
        counts = baselines.calendar_counts(frame.where(F.col("split") == "train"), layout=layout)
    for name in settings.models:
        part = _narrow(forecast(frame, name, settings, run_dir, resume, layout, counts), name, layout)
        if run_dir:
            path = f"{run_dir}/scored/model={name}"
            write_table(part.drop("model"), path)
            part = spark.read.parquet(path).withColumn("model", F.lit(name)).select(part.columns)
        else:
            part = freeze(part)
        parts.append(part)
    scored = metrics.stack_scored(parts)
    table, board = _board(scored, settings)
    if run_dir:
        write_csv(board.coalesce(1), f"{run_dir}/model_compare")
        write_table(sketches.error_sketches(scored), f"{run_dir}/sketches")
        for name, example in examples_of(scored, list(settings.models), layout).items():
            write_csv(example.coalesce(1), f"{run_dir}/examples/{name}")
    if results:
        rows = board.select("run_id", "model", "task", "split_mode", "horizon", *RESULT_COLUMNS, "note")
        append_results(rows, results)
    return RunResult(board, table, scored, split_counts(frame, layout))


def run_percentiles(
    spark: SparkSession, run_dirs: Sequence[str], probabilities: Mapping[str, float] | None = None, by: Sequence[str] = metrics.GROUP
) -> DataFrame:
    """Percentiles of the absolute errors of several runs together, from their stored sketches: no scored row is read."""
    stored = [spark.read.parquet(f"{run_dir}/sketches") for run_dir in run_dirs]
    merged = sketches.merge_sketches(reduce(DataFrame.unionByName, stored), by)
    wanted = probabilities or {f"P{p}_abs_err": p / 100.0 for p in metrics.PERCENTILES}
    return sketches.sketch_quantiles(merged, wanted, by)


def examples_of(scored: DataFrame, models: list[str], layout: Layout, split_name: str = "test") -> dict[str, DataFrame]:
    """Per model the first scored rows of a split and the gap example of its first eligible series."""
    found = {}
    for name in models:
        rows = scored.where((F.col("model") == name) & (F.col("split") == split_name))
        found[f"{name}_first_scored"] = examples.first_scored(rows, layout=layout)
        found[f"{name}_gap"] = examples.gap_example(rows, user_rank=0, layout=layout).orderBy(*layout.full_order)
    return found


def load_settings(spark: SparkSession, run_dir: str, fallback: RunSettings | None = None) -> tuple[RunSettings, str | None]:
    try:
        about = json.loads(spark.read.parquet(f"{run_dir}/settings").first()["settings"])
    except AnalysisException:
        if fallback is None:
            raise FileNotFoundError(f"no settings in {run_dir} and no fallback given") from None
        return fallback, None
    path = about.pop("features_path")
    about["tolerances"], about["exclude"] = tuple(about["tolerances"]), tuple(about["exclude"])
    return RunSettings(**about), path


def rescore_run(
    spark: SparkSession,
    run_dir: str,
    features: DataFrame | None = None,
    tolerances: tuple[float, ...] | None = None,
    fallback: RunSettings | None = None,
    layout: Layout | None = None,
) -> RunResult:
    """Split again as the run did, score every saved model and the naive forecast, rank anew.

    A model that cannot be loaded is left out with a warning; an error while it is applied ends the job.
    """
    settings, path = load_settings(spark, run_dir, fallback)
    if features is None:
        if path is None:
            raise ValueError("the run did not record where its features are; pass them")
        features = spark.read.parquet(path)
    if tolerances:
        settings = RunSettings(**{**asdict(settings), "tolerances": tuple(tolerances)})
    layout = layout or layout_of(features.columns)
    frame, _ = prepare(features, settings, layout)
    parts = []
    if _previous(features):
        parts.append(_narrow(baselines.naive_forecast(frame, "ref_prev"), "naive_last", layout))
    for name in saved_models(spark, f"{run_dir}/models"):
        try:
            model = load_model(spark, f"{run_dir}/models/{name}")
        except (AnalysisException, FileNotFoundError, KeyError, ValueError) as error:
            warnings.warn(f"model {name!r} of {run_dir} cannot be loaded: {error}", stacklevel=2)
            continue
        parts.append(freeze(_narrow(model.transform(frame), name, layout)))
    scored = metrics.stack_scored(parts)
    table, board = _board(scored, settings)
    write_csv(board.coalesce(1), f"{run_dir}/model_compare")
    return RunResult(board, table, scored, split_counts(frame, layout))
