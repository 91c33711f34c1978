"""Train a URL classifier on a stratified part and evaluate it on the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from netsight.ml import evaluate, registry, split, urls
from netsight.session import cut_lineage


@dataclass
class Evaluation:
    model: PipelineModel
    scored: DataFrame
    confusion: DataFrame
    roc: DataFrame
    auc: DataFrame
    report: DataFrame


def train_and_evaluate(name: str, rows: DataFrame, *, test_share: float = 0.3, seed: int = urls.SEED, **params) -> Evaluation:
    """Rows with `url` and `type`. Curves use probabilities, or raw scores for a model without them."""
    train, test = split.stratified_split(rows, test_share=test_share, seed=seed)
    # Stored once: the split and the model are then applied once for all results below.
    model = registry.train_urls(name, cut_lineage(train), **params)
    scored = cut_lineage(
        urls.score(model, test).withColumnsRenamed({"type": "label", "prediction_label": "prediction"})
    )
    classes = urls.classes_of(model)
    return Evaluation(
        model,
        scored,
        evaluate.confusion_matrix(scored, classes),
        evaluate.roc_curve(scored, classes),
        evaluate.auc(scored, classes),
        evaluate.classification_report(scored),
    )
