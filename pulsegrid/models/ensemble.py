"""Sums of many trees as one public Spark model.

The nodes of all trees form one flat table. From it a ``GBTRegressionModel`` is made through Spark's own model format, so a
row is scored by one call that walks all trees in the JVM: the plan has one step however many trees there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.models.growth import FlatTree
from pulsegrid.session import freeze, scratch_path

SCORE = "_trees"
_FIELDS = ("feature", "threshold", "left", "right", "value")
_TYPES = (np.int32, np.float64, np.int32, np.int32, np.float64)


def node_table(spark: SparkSession, trees: Sequence[FlatTree], first: int = 0) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value) of trees numbered from ``first``."""
    sizes = [t.size for t in trees]
    columns = {
        "tree": np.repeat(np.arange(first, first + len(trees), dtype=np.int32), sizes),
        "node": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.empty(0, np.int32)]),
    }
    for name, kind in zip(_FIELDS, _TYPES):
        columns[name] = np.concatenate([np.asarray(getattr(t, name), dtype=kind) for t in trees] or [np.empty(0, kind)])
    return spark.createDataFrame(pa.table(columns))


def write_trees(spark: SparkSession, trees: Sequence[FlatTree], path: str, first: int = 0) -> None:
    node_table(spark, trees, first).coalesce(1).write.mode("overwrite").parquet(path)


def read_trees(nodes: DataFrame, count: int) -> list[FlatTree]:
    """The first ``count`` trees of a node table; a tree that was written twice counts once."""
    rows = nodes.where(F.col("tree") < count).select("tree", "node", *_FIELDS).toPandas()
    rows = rows.drop_duplicates(["tree", "node"]).sort_values(["tree", "node"])
    found = [FlatTree(*(part[name].tolist() for name in _FIELDS)) for _, part in rows.groupby("tree")]
    if len(found) != count:
        raise ValueError(f"{len(found)} trees instead of {count}")
    return found


def _about(kind: str, spark: SparkSession, params: dict, **more) -> str:
    """Spark's description of a saved model."""
    about = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}"}
    return json.dumps({**about, "paramMap": params, "defaultParamMap": {}, **more})


def tree_sum(spark: SparkSession, trees: Sequence[FlatTree], weight: float, score: str = SCORE) -> GBTRegressionModel:
    """A model whose ``score`` is ``weight`` times the sum of the trees' values."""
    return tree_sum_of(node_table(spark, trees), len(trees), weight, score)


def tree_sum_of(nodes: DataFrame, trees: int, weight: float, score: str = SCORE) -> GBTRegressionModel:
    """The same from a node table; the nodes go from table to model without passing through Python."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "ensemble")
    nodes = freeze(nodes, f"{path}/nodes")
    width = 1 + max(nodes.agg(F.max("feature")).first()[0] or 0, 0)
    params = {"predictionCol": score, "featuresCol": "features", "impurity": "variance"}
    whole = _about("GBTRegressionModel", spark, params, numFeatures=width, numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    single = _about("DecisionTreeRegressionModel", spark, {"featuresCol": "features", "impurity": "variance"})
    spark.range(trees).select(
        F.col("id").cast("int").alias("_1"), F.lit(single).alias("_2"), F.lit(float(weight)).alias("_3")
    ).write.parquet(f"{path}/treesMetadata")
    none = F.lit(-1)
    inner = F.col("feature") >= 0
    cut = F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    split = F.struct(
        F.col("feature").alias("featureIndex"), cut.alias("leftCategoriesOrThreshold"), none.alias("numCategories")
    )
    zero = F.lit(0.0)
    node = F.struct(
        F.col("node").alias("id"), F.col("value").alias("prediction"), zero.alias("impurity"),
        F.array(zero, zero, zero).alias("impurityStats"), F.lit(0).cast("long").alias("rawCount"),
        F.when(inner, 0.0).otherwise(-1.0).alias("gain"), F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"), split.alias("split"),
    )
    nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)
