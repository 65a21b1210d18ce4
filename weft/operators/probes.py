"""Probes over vector columns: scaled logistic regression and boosted trees, and leaving a group out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.statistics import balanced_weights


def _prepared(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))


def linear_probe(train: DataFrame, embedding: str, label: str, ridge: float = 1e-3) -> Callable[[DataFrame], DataFrame]:
    """Fit on class-balanced weights; returns a function that adds `probability`."""
    data = balanced_weights(_prepared(train, embedding), [label], 0.5)
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol=label, weightCol="weight", regParam=ridge, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")]).fit(data)
    return lambda df: model.transform(_prepared(df, embedding)).withColumn("probability", vector_to_array("_p")[1]).drop("_v", "_s", "_p", "_r", "_c")


def tree_probe(train: DataFrame, embedding: str, label: str, trees: int = 20, depth: int = 3) -> Callable[[DataFrame], DataFrame]:
    model = GBTClassifier(featuresCol="_v", labelCol=label, maxIter=trees, maxDepth=depth, seed=7).fit(_prepared(train, embedding))
    return lambda df: model.transform(_prepared(df, embedding)).withColumn("probability", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "prediction")


def leave_one_group_out(df: DataFrame, group: str, groups: Sequence, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every row scored by a probe that has not seen its group; one fit for each of the groups named."""
    out = None
    for g in groups:
        scored = fit(df.where(F.col(group) != g))(df.where(F.col(group) == g))
        out = scored if out is None else out.unionByName(scored)
    return out
