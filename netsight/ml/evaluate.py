"""Evaluation of classifiers as DataFrame aggregates.

Inputs: `label` (true class), `prediction` (predicted class), `scores` (map class -> score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.operators.quantile import running_totals
from netsight.session import cut_lineage

MICRO = "micro-avg"


#: A column with more values than this is no column of classes.
MOST_CLASSES = 1000


def classes_of(scored: DataFrame, column: str = "label") -> list[str]:
    """Sorted class names: a handful of values, whatever the number of rows."""
    found = scored.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{column} has over {MOST_CLASSES} values: these are no classes")
    return sorted(r[0] for r in found)


def confusion_matrix(scored: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Rows per (label, prediction) over all pairs of classes, 0 where a pair does not occur."""
    names = list(classes) if classes is not None else classes_of(scored)
    counts = (
        scored.filter(F.col("label").isin(names) & F.col("prediction").isin(names))
        .groupBy("label", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = scored.sparkSession.createDataFrame(
        [(a, b, 0) for a in names for b in names], "label string, prediction string, n bigint"
    )
    return (
        counts.unionByName(pairs)
        .groupBy("label", "prediction")
        .agg(F.sum("n").alias("n"))
        .orderBy("label", "prediction")
    )


def _per_score(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Positives and negatives per (curve, score): rows with equal scores share one point."""
    names = list(classes)
    if len(names) == 2:
        # Two classes need one curve, with the second as the positive class.
        curves = scored.select(
            F.lit(names[1]).alias("curve"),
            F.col("scores")[names[1]].alias("score"),
            (F.col("label") == names[1]).alias("hit"),
        )
    else:
        one_vs_rest = F.array(*[
            F.struct(
                F.lit(c).alias("curve"),
                F.col("scores")[c].alias("score"),
                (F.col("label") == c).alias("hit"),
            )
            for c in names
        ])
        each = scored.select(F.explode(one_vs_rest).alias("x")).select("x.*")
        per_class = _tally(each)
        micro = per_class.withColumn("curve", F.lit(MICRO)).groupBy("curve", "score").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
        return per_class.unionByName(micro)
    return _tally(curves)


def _tally(curves: DataFrame) -> DataFrame:
    return curves.filter(F.col("score").isNotNull()).groupBy("curve", "score").agg(
        F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg")
    )


def _counted(scored: DataFrame, classes: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    tally = cut_lineage(_per_score(scored, classes if classes is not None else classes_of(scored)))
    counted = running_totals(tally, ["curve"], "score", ["pos", "neg"])
    totals = tally.groupBy("curve").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return counted, totals


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def roc_curve(scored: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Points (curve, threshold, fpr, tpr): one per distinct score, plus the origin at +infinity."""
    counted, totals = _counted(scored, classes)
    # `totals` has one row per class, whatever the number of rows.
    points = counted.join(F.broadcast(totals), "curve").select(
        "curve",
        F.col("score").alias("threshold"),
        _share(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        _share(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = totals.select(
        "curve", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def auc(scored: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Trapezoid area under each curve, from the same counts: a step of neg to the right has the
    height of the positives above it plus half of its own."""
    counted, _ = _counted(scored, classes)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0)))
    return (
        counted.groupBy("curve")
        .agg(area.alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select("curve", _share(F.col("area"), F.col("p") * F.col("n")).alias("auc"))
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; accuracy; macro and weighted averages. 0/0 is 0."""
    counts = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    roles = F.array(
        F.struct(F.col("label").alias("name"), F.lit(1).alias("true"), F.lit(0).alias("said")),
        F.struct(F.col("prediction").alias("name"), F.lit(0).alias("true"), F.lit(1).alias("said")),
    )
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    n = F.col("n")
    per = (
        counts.withColumn("right", right)
        .withColumn("role", F.explode(roles))
        .groupBy(F.col("role")["name"].alias("name"))
        .agg(
            F.sum(F.col("right") * F.col("role")["true"]).alias("tp"),
            F.sum(n * F.col("role")["true"]).alias("support"),
            F.sum(n * F.col("role")["said"]).alias("said"),
        )
    )

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, support, said = F.col("tp"), F.col("support"), F.col("said")
    measures = per.select(
        "name",
        safe(tp, said).alias("precision"),
        safe(tp, support).alias("recall"),
        safe(tp * 2, said + support).alias("f1_score"),
        "support",
        "tp",
    )
    three = ["precision", "recall", "f1_score"]
    accuracy = safe(F.sum("tp"), F.sum("support"))
    total = F.sum("support").alias("support")
    rows = ["name", *three, "support"]
    return (
        measures.select(*rows)
        .unionByName(measures.agg(
            F.lit("accuracy").alias("name"), *[accuracy.alias(c) for c in three], total))
        .unionByName(measures.agg(
            F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in three], total))
        .unionByName(measures.agg(
            F.lit("weighted avg").alias("name"),
            *[safe(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in three], total))
    )
