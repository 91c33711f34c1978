"""Models by name: training, versioned storage, and the analyst's current choice."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.ml import anomaly, urls

# Model names and the choice before anybody chose.
URL_MODELS = ("DecisionTree", "RandomForest", "LinearSVM")
BEHAVIOUR_MODELS = ("IsolationForest", "Autoencoder", "OneClassSVM")
DEFAULT_MODEL = "DecisionTree"


class UnknownModel(ValueError):
    pass


BEHAVIOUR_CLASSES = {
    "IsolationForest": anomaly.IsolationForest,
    "Autoencoder": anomaly.Autoencoder,
    "OneClassSVM": anomaly.OneClassSVM,
}


def check(name: str) -> str:
    if name not in URL_MODELS + BEHAVIOUR_MODELS:
        raise UnknownModel(f"Unsupported model: {name}")
    return name


def train_urls(name: str, rows: DataFrame, *, vocabulary: int = urls.VOCABULARY, **params) -> PipelineModel:
    makers: dict[str, Callable] = {
        "DecisionTree": lambda n: urls.decision_tree(**params),
        "RandomForest": lambda n: urls.random_forest(**params),
        "LinearSVM": lambda n: urls.linear_svm(n, **params),
    }
    if name not in makers:
        raise UnknownModel(f"{name} is not a URL model")
    return urls.fit_classifier(rows, makers[name], vocabulary=vocabulary)


def train_behaviour(name: str, rows: DataFrame, columns: Sequence[str], **params):
    if name not in BEHAVIOUR_CLASSES:
        raise UnknownModel(f"{name} is not a behaviour model")
    return BEHAVIOUR_CLASSES[name](**params).fit(rows, columns)


def _pack(value):
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "type": str(value.dtype)}
    if isinstance(value, anomaly.Scaler):
        return {"scaler": vars(value)}
    if isinstance(value, list | tuple):
        return [_pack(v) for v in value]
    return value


def _unpack(value):
    if isinstance(value, list):
        return [_unpack(v) for v in value]
    if isinstance(value, dict):
        return anomaly.Scaler(**value["scaler"]) if "scaler" in value else np.array(value["array"], value["type"])
    return value


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("name string, version int, path string, state string").parquet(f"{root}/versions")
    except Exception as e:  # no model stored yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def newest_version(spark: SparkSession, root: str, name: str) -> str | None:
    """Path of the newest stored version: another one for each."""
    known = _versions(spark, root)
    row = _newest(known, name) if known is not None else None
    return row.path if row else None


def _newest(known: DataFrame, name: str):
    """Of two writers that took the same number at the same time, the same one wins everywhere."""
    return known.filter(F.col("name") == name).orderBy(F.desc("version"), F.desc("path")).first()


def save(spark: SparkSession, root: str, name: str, model) -> str:
    """Store a new version: the model first, then the row that makes it visible."""
    check(name)
    known = _versions(spark, root)
    last = known.filter(F.col("name") == name).agg(F.max("version")).first()[0] if known is not None else None
    version = (last or 0) + 1
    # The path has a name of its own, so that two writers never write to one place.
    path, state = f"{root}/{name}/v{version}-{uuid.uuid4().hex}", None
    if name in URL_MODELS:
        model.write().overwrite().save(path)
    else:
        state = json.dumps({k: _pack(v) for k, v in vars(model).items()})
    spark.createDataFrame(
        [(name, version, path, state)], "name string, version int, path string, state string"
    ).write.mode("append").parquet(f"{root}/versions")
    return path


def load(spark: SparkSession, root: str, name: str):
    """Newest stored version of a model."""
    check(name)
    known = _versions(spark, root)
    row = _newest(known, name) if known is not None else None
    if row is None:
        raise FileNotFoundError(f"no stored model {name}")
    if name in URL_MODELS:
        return PipelineModel.load(row.path)
    return BEHAVIOUR_CLASSES[name](**{k: _unpack(v) for k, v in json.loads(row.state).items()})


def choose(spark: SparkSession, root: str, name: str) -> None:
    """Record the analyst's choice in the control table."""
    check(name)
    spark.range(1).select(
        F.lit(name).alias("name"), F.current_timestamp().alias("chosen_at"), F.expr("uuid()").alias("choice")
    ).write.mode("append").parquet(f"{root}/chosen")


def current(spark: SparkSession, root: str) -> str:
    try:
        chosen = spark.read.schema("name string, chosen_at timestamp, choice string").parquet(f"{root}/chosen")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return DEFAULT_MODEL
        raise
    row = chosen.orderBy(F.desc("chosen_at"), "choice").first()
    return row.name if row else DEFAULT_MODEL
