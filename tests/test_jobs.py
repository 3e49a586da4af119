from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulsegrid.models import registry
from pulsegrid.models.store import describe_model, load_model
from pulsegrid.operators.sketches import rank_error
from pulsegrid.plans.features import FeatureSettings, build_features
from pulsegrid.plans.train import RunSettings, load_settings, prepare, rescore_run, run_percentiles, train_and_compare
from pulsegrid.sources.sinks import read_results

FEATURES = FeatureSettings(user_id_encoding="drop", allow_step_inputs=True, lags=(1, 2), roll_windows=(4,))


@pytest.fixture(scope="module")
def features_path(spark, signal, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "table")
    build_features(signal, FEATURES).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def run(spark, features_path, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    settings = RunSettings(
        "r1", models={"naive_last": {}, "median": {}, "linreg": {}, "hgb_q80": {"rounds": 1}}, tolerances=(50,), note="n"
    )
    features = spark.read.parquet(features_path)
    result = train_and_compare(
        features, settings, str(folder / "run"), str(folder / "results"), features_path=features_path
    )
    return folder, settings, {r["model"]: r.asDict() for r in result.board.collect()}, result


def test_board(run):
    _, settings, board, result = run
    assert set(board) == set(settings.models)
    assert sorted(r["rank"] for r in board.values()) == [1, 2, 3, 4]
    assert board["naive_last"]["Lift_val_MAE"] == 0.0 and board["median"]["Lift_test_MAE"] > 0
    assert board["hgb_q80"]["ToleranceAcc@50_val"] is not None and board["linreg"]["MAE_train"] is not None
    assert result.counts.agg(F.sum("rows")).first()[0] * 4 == result.scored.count()


def test_results_table_grows(spark, run):
    folder, settings, board, _ = run
    rows = read_results(spark, str(folder / "results")).collect()
    assert {(r["run_id"], r["model"]) for r in rows} == {("r1", m) for m in settings.models}
    csv = spark.read.option("header", True).csv(str(folder / "run" / "model_compare"))
    assert csv.count() == 4 and csv.columns[:2] == ["rank", "model"]


def test_percentiles_of_stored_sketches(spark, run):
    """Errors of a run from its sketches, within the stated bound of the scored rows."""
    folder, _, _, result = run
    found = run_percentiles(spark, [str(folder / "run")] * 2, {"p": 0.75}).collect()
    errors = result.scored.selectExpr("model", "split", "abs(y - yhat) AS e").where("e IS NOT NULL").toPandas()
    for row in found:
        e = errors[(errors.model == row["model"]) & (errors.split == row["split"])].e
        assert row["n"] == 2 * len(e)
        assert (e < row["p"]).mean() - rank_error() <= 0.75 <= (e <= row["p"]).mean() + rank_error()
    assert len(found) == 12


def test_resume_loads_instead_of_fitting(spark, run, features_path, monkeypatch):
    folder, settings, board, _ = run

    def refuse(*args, **kwargs):
        raise AssertionError("must not fit")

    monkeypatch.setattr("pulsegrid.plans.train.make_model", refuse)
    again = train_and_compare(spark.read.parquet(features_path), settings, str(folder / "run"), resume=True)
    for row in again.board.collect():
        assert row["MAE_val"] == pytest.approx(board[row["model"]]["MAE_val"])


def test_rescore(spark, run):
    folder, settings, board, _ = run
    found = {r["model"]: r.asDict() for r in rescore_run(spark, str(folder / "run"), tolerances=(25, 100)).board.collect()}
    assert set(found) == {"naive_last", "linreg", "hgb_q80"}
    for name, row in found.items():
        assert row["MAE_test"] == pytest.approx(board[name]["MAE_test"])
        assert row["ToleranceAcc@25_val"] <= row["ToleranceAcc@100_val"]


def test_rescore_passes_over_a_broken_model(spark, run, features_path, tmp_path):
    settings = RunSettings("r2", models={"linreg": {}})
    folder = str(tmp_path / "run")
    features = spark.read.parquet(features_path)
    train_and_compare(features, settings, folder, features_path=features_path)
    broken = RunSettings("r2", models={"linreg": {}, "huber": {}})
    with pytest.raises(FileNotFoundError):
        load_settings(spark, str(tmp_path / "nothing"))
    assert load_settings(spark, str(tmp_path / "nothing"), broken) == (broken, None)
    spark.createDataFrame([('{"kind": "LinearRegressionModel"}',)], "about string").write.parquet(f"{folder}/models/huber/about")
    with pytest.warns(UserWarning, match="huber"):
        found = rescore_run(spark, folder)
    assert {r["model"] for r in found.board.collect()} == {"naive_last", "linreg"}


def test_prepare_filters_splits_and_selects(spark, features_path):
    features = spark.read.parquet(features_path)
    lengths = sorted(r["count"] for r in features.groupBy("user_id").count().collect())
    settings = RunSettings("p", min_samples_per_user=lengths[3], split_mode="per_user", split={"val_days": 3, "test_days": 2}, exclude=("user_id",))
    frame, inputs = prepare(features, settings)
    assert frame.select("user_id").distinct().count() == sum(n >= lengths[3] for n in lengths)
    assert not {"user_id", "event_id", "ref_prev", "steps", "steps_t"} & set(inputs)
    assert {"steps_lag1", "dow", "hr_mean_4"} <= set(inputs)
    assert len(frame.first()["features"]) == len(inputs)


def test_global_mode(spark, features_path):
    features = spark.read.parquet(features_path)
    settings = RunSettings("g", split_mode="global_time", split={"train_until": "2024-01-20", "valid_until": "2024-01-25"})
    frame, _ = prepare(features, settings)
    spans = {r["split"]: (r["a"], r["z"]) for r in frame.groupBy("split").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).collect()}
    assert spans["train"][1] <= spans["val"][0] and spans["val"][1] <= spans["test"][0]


def test_vector_encoding_reaches_the_models(spark, signal):
    features = build_features(signal, FeatureSettings(lags=(1,), roll_windows=(), user_id_encoding="vector"))
    frame, inputs = prepare(features, RunSettings("v", exclude=("user_id",)))
    users = signal.select("user_id").distinct().count()
    assert "user_id_vec" in inputs and len(frame.first()["features"]) == len(inputs) - 1 + users - 1
    registry.make_model("linreg").fit(frame.where("split = 'train'"))


def test_missing_model_is_reported(spark, tmp_path):
    assert describe_model(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))


def test_readme_quick_start(spark, tmp_path):
    """Matrix cells through build, features, train, score again and profile, as the README shows it."""
    from pulsegrid.plans.build import build_signal
    from pulsegrid.plans.profile import run_profile

    rows, days = 8, 60
    matrix = lambda u: [[float((u * 7 + r * 3 + c * 5) % 90) for c in range(days)] for r in range(rows)]
    times = [[739253.0 + c + r / rows for c in range(days)] for r in range(rows)]
    cells = [(u, matrix(u), matrix(u + 1), [739253.0 + c for c in range(days)], times) for u in (1, 2, 3)]
    schema = "user_id long, steps array<array<double>>, hr array<array<double>>, date_dnum array<double>, dt_dnum array<array<double>>"
    spark.createDataFrame(cells, schema).write.parquet(str(tmp_path / "cells"))

    signal = build_signal(spark, str(tmp_path / "cells"), str(tmp_path / "signal"), min_days=50)
    features = build_features(signal, FeatureSettings(horizon=1, allow_step_inputs=True))
    features.write.parquet(str(tmp_path / "features"))
    run = train_and_compare(
        spark.read.parquet(str(tmp_path / "features")),
        RunSettings("run-1", models={"naive_last": {}, "median": {}, "linreg": {}}),
        run_dir=str(tmp_path / "run-1"),
        results=str(tmp_path / "results"),
        features_path=str(tmp_path / "features"),
    )
    assert run.board.count() == 3
    assert rescore_run(spark, str(tmp_path / "run-1"), tolerances=(50, 100)).board.count() == 2
    paths = run_profile(signal, str(tmp_path / "report"))
    flat = spark.read.option("header", True).csv(paths["dataset_flat"])
    assert flat.count() == 3 * rows * days
    _, inputs = prepare(features, RunSettings("p"))
    assert {"row_idx", "col_idx", "user_id_vec"} <= set(inputs)


def test_naive_needs_a_previous_value(spark, features_path):
    features = spark.read.parquet(features_path).drop("ref_prev", "steps_lag1")
    with pytest.raises(ValueError, match="previous value"):
        train_and_compare(features, RunSettings("n", models={"naive_last": {}}))


def test_execution_errors_are_not_swallowed(spark, run, features_path, monkeypatch):
    folder, settings, _, _ = run

    class Broken:
        def transform(self, frame):
            raise RuntimeError("executor lost")

    monkeypatch.setattr("pulsegrid.plans.train.load_model", lambda *a: Broken())
    with pytest.raises(RuntimeError, match="executor lost"):
        rescore_run(spark, str(folder / "run"), spark.read.parquet(features_path))
