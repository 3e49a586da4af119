"""Models made of other models: blends and the two-stage activity model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.weights import active_weight, expected_value
from pulsegrid.models import store
from pulsegrid.models.boosting import BoostedTrees, fit_side_by_side


class Blend(Estimator):
    """Weighted sum of independently fitted models. Boosted ones that need the same binned rows share them."""

    def __init__(self, parts: Sequence[Estimator], weights: Sequence[float]):
        super().__init__()
        self.parts, self.weights = list(parts), [float(w) for w in weights]

    def _fit(self, df: DataFrame) -> BlendModel:
        alike: dict[object, list[int]] = {}
        for i, part in enumerate(self.parts):
            shared = type(part) is BoostedTrees and part.resume_dir is None
            alike.setdefault(part._rows_alike() if shared else i, []).append(i)
        models: dict[int, Model] = {}
        for places in alike.values():
            parts = [self.parts[i] for i in places]
            models |= zip(places, fit_side_by_side(parts, df) if len(parts) > 1 else [parts[0].fit(df)])
        return BlendModel([models[i] for i in range(len(self.parts))], self.weights)


class BlendModel(Model):
    def __init__(self, parts: Sequence[Model], weights: Sequence[float]):
        super().__init__()
        self.parts, self.weights = list(parts), list(weights)

    def part_forecasts(self, df: DataFrame) -> DataFrame:
        """One column ``yhat0``, ``yhat1``, ... per part."""
        rows = df
        for i, part in enumerate(self.parts):
            rows = part.transform(rows).select(*rows.columns, F.col("yhat").alias(f"yhat{i}"))
        return rows

    def _transform(self, df: DataFrame) -> DataFrame:
        total = sum((F.lit(w) * F.col(f"yhat{i}") for i, w in enumerate(self.weights)), F.lit(0.0))
        return self.part_forecasts(df).select(*df.columns, total.alias("yhat"))

    def save_parts(self, spark: SparkSession, path: str) -> dict:
        for i, part in enumerate(self.parts):
            store.save_model(spark, part, f"{path}/part{i}")
        return {"weights": self.weights}

    @classmethod
    def load_parts(cls, spark: SparkSession, path: str, meta: dict) -> BlendModel:
        parts = [store.load_model(spark, f"{path}/part{i}") for i in range(len(meta["weights"]))]
        return cls(parts, meta["weights"])


class TwoStage(Estimator):
    """Chance of activity times the size of activity, the latter fitted on active rows only."""

    def __init__(
        self,
        regressor: Estimator,
        threshold: float = 50,
        active_row_weight: float = 3.0,
        rounds: int = 100,
        step: float = 0.1,
        depth: int = 6,
        bins: int = 255,
        min_leaf: int = 200,
        seed: int = 42,
    ):
        super().__init__()
        self.regressor, self.threshold, self.active_row_weight = regressor, threshold, active_row_weight
        self.classifier = GBTClassifier(
            labelCol="_active",
            weightCol="_weight",
            predictionCol="_class",
            maxIter=rounds,
            stepSize=step,
            maxDepth=depth,
            maxBins=bins,
            minInstancesPerNode=min_leaf,
            seed=seed,
        )
        self.classifier.setProbabilityCol("_probability")
        self.classifier.setRawPredictionCol("_raw")

    def _fit(self, df: DataFrame) -> TwoStageModel:
        label = F.col("label")
        rows = df.withColumns(
            {
                "_active": (label >= self.threshold).cast("double"),
                "_weight": active_weight(label, self.threshold, self.active_row_weight),
            }
        )
        active = df.where(label >= self.threshold)
        regressor = self.regressor.fit(df if active.isEmpty() else active)
        return TwoStageModel(self.classifier.fit(rows), regressor)


class TwoStageModel(Model):
    def __init__(self, classifier: Model, regressor: Model):
        super().__init__()
        self.classifier, self.regressor = classifier, regressor

    def _transform(self, df: DataFrame) -> DataFrame:
        sized = self.regressor.transform(df).withColumnRenamed("yhat", "_size")
        judged = self.classifier.transform(sized)
        chance = vector_to_array("_probability")[1]
        return judged.select(*df.columns, expected_value(chance, F.col("_size")).alias("yhat"))

    def save_parts(self, spark: SparkSession, path: str) -> dict:
        store.save_model(spark, self.classifier, f"{path}/classifier")
        store.save_model(spark, self.regressor, f"{path}/regressor")
        return {}

    @classmethod
    def load_parts(cls, spark: SparkSession, path: str, meta: dict) -> TwoStageModel:
        return cls(store.load_model(spark, f"{path}/classifier"), store.load_model(spark, f"{path}/regressor"))
