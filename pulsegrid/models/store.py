"""Saving and loading fitted models, Spark ML's own and the ones built here."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession, functions as F

_NATIVE = {
    c.__name__: c
    for c in (
        PipelineModel,
        LinearRegressionModel,
        RandomForestRegressionModel,
        GBTRegressionModel,
        GBTClassificationModel,
    )
}


def _built_here() -> dict:
    from pulsegrid.models.boosting import BoostedTreesModel
    from pulsegrid.models.composite import BlendModel, TwoStageModel
    from pulsegrid.models.forest import RandomForestModel
    from pulsegrid.models.linear import LinearModel

    return {c.__name__: c for c in (BoostedTreesModel, BlendModel, TwoStageModel, LinearModel, RandomForestModel)}


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The description is written last: a model without one was not saved completely."""
    kind = type(model).__name__
    if kind in _NATIVE:
        model.write().overwrite().save(f"{path}/native")
        meta = {}
    else:
        meta = model.save_parts(spark, path)
    about = spark.createDataFrame([(json.dumps({"kind": kind, **meta}),)], "about string")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def describe_model(spark: SparkSession, path: str) -> dict | None:
    """Description of a saved model, None if there is none."""
    try:
        row = spark.read.parquet(f"{path}/about").first()
    except AnalysisException:
        return None
    return json.loads(row["about"]) if row else None


def saved_models(spark: SparkSession, folder: str) -> list[str]:
    """Names of the completely saved models directly below ``folder``."""
    try:
        files = spark.read.parquet(f"{folder}/*/about").select(F.input_file_name().alias("file"))
    except AnalysisException:
        return []
    name = F.regexp_extract("file", r"([^/]+)/about/[^/]+$", 1)
    return sorted(row[0] for row in files.select(name).distinct().collect())


def load_model(spark: SparkSession, path: str) -> Model:
    meta = describe_model(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no saved model at {path}")
    kind = meta["kind"]
    if kind in _NATIVE:
        return _NATIVE[kind].load(f"{path}/native")
    return _built_here()[kind].load_parts(spark, path, meta)
