"""Trained supplier scorer: features, fit, score, versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestline.constants import FEATURES
from harvestline.functions import scoring
from harvestline.operators import aggregates, latest
from harvestline.plans import boosting

SEED = 7


def check_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """The model's columns first, in model order, as doubles; raise if one is missing."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    wrong = [c for c in features if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"feature columns not numeric: {wrong}")
    rest = [c for c in df.columns if c not in features]
    return df.select(*[F.col(c).cast("double").alias(c) for c in features], *rest)


def training_set(features: DataFrame, noise: float = 0.0) -> DataFrame:
    """Feature rows labelled with the closed-form score, with optional seeded noise."""
    labelled = scoring.score_closed_form(features).withColumnRenamed("score", "label")
    if noise:
        shaken = F.col("label") + noise * F.randn(SEED)
        labelled = labelled.withColumn("label", F.least(F.greatest(shaken, F.lit(0.0)),
                                                        F.lit(1.0)))
    return check_features(labelled).select(*FEATURES, "label")


class Trained(NamedTuple):
    model: PipelineModel
    test: DataFrame


def split(labelled: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the row, so that a recomputed partition splits the same way."""
    return labelled.where(~held_out(test_share)), labelled.where(held_out(test_share))


def held_out(test_share: float = 0.2) -> Column:
    """Whether a row of features in model order and type is in the test part."""
    return F.pmod(F.xxhash64(*FEATURES, F.lit(SEED)), F.lit(1000)) / 1000.0 < test_share


def fit(labelled: DataFrame, *, trees: int = 250, depth: int = 4, rate: float = 0.05) -> Trained:
    """Standardise the features and fit gradient-boosted trees on 80 % of the rows."""
    train, test = split(labelled)
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED),
    ]
    return Trained(Pipeline(stages=stages).fit(train), test)


def predict(model: PipelineModel, features: DataFrame, name: str = "score") -> DataFrame:
    """Score rows in the JVM and clip to 0..1. Other columns keep their types."""
    columns = features.columns
    scored = model.transform(features)
    clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select(*columns, clipped.alias(name))


def scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A fitted model in the shape the leaderboard takes."""
    return lambda features: predict(model, features)


def vectorised_scorer(load: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                      extra: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Scorer around any Python model. `load` runs once per Python worker, the model then
    gets Arrow batches of the feature columns."""
    inputs = FEATURES + (extra or [])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            yield model(pd.concat(columns, axis=1, keys=inputs))

    return lambda features: features.withColumn(
        "score", score(*[F.col(c).cast("double") for c in inputs]))


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    return aggregates.mean_absolute_error(predict(model, test), "label", "score")


# ---- versions ---------------------------------------------------------------------

ALIAS_SCHEMA = "name string, alias string, version int, moved_at bigint"


def save_version(model: PipelineModel, root: str, version: int) -> str:
    """Write a model version; an existing version is never overwritten."""
    path = f"{root}/v{version}"
    model.write().save(path)
    return path


def save_trees(trees: DataFrame, root: str, version: int) -> str:
    """Write a table of boosted trees as a model version; an existing version is never overwritten."""
    path = f"{root}/v{version}"
    trees.coalesce(1).write.parquet(path)
    return path


def load_trees(spark: SparkSession, root: str, name: str, alias: str = "prod") -> DataFrame:
    return spark.read.schema(boosting.NODES).parquet(f"{root}/v{resolve_alias(spark, root, name, alias)}")


def move_alias(spark: SparkSession, root: str, name: str, alias: str, version: int) -> None:
    """Point an alias at a version by appending to the alias table."""
    moves = aliases(spark, root)
    last = moves.agg(F.max("moved_at")).first()[0] if moves is not None else None
    spark.createDataFrame([(name, alias, version, (last or 0) + 1)], ALIAS_SCHEMA).coalesce(
        1).write.mode("append").parquet(f"{root}/aliases")


def aliases(spark: SparkSession, root: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/aliases")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(ALIAS_SCHEMA).parquet(f"{root}/aliases")


def resolve_alias(spark: SparkSession, root: str, name: str, alias: str) -> int:
    """Version the alias points at now."""
    moves = aliases(spark, root)
    current = None if moves is None else latest.latest_per_key(
        moves, ["name", "alias"], "moved_at", ["version"]
    ).where((F.col("name") == name) & (F.col("alias") == alias)).first()
    if current is None:
        raise LookupError(f"no version of {name} has alias {alias}")
    return current.version


def load_alias(spark: SparkSession, root: str, name: str, alias: str = "prod") -> PipelineModel:
    return PipelineModel.load(f"{root}/v{resolve_alias(spark, root, name, alias)}")
