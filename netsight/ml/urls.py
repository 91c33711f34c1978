"""URL classification: character n-gram TF-IDF and three classifiers, as persistable Spark pipelines.

Input columns `url`, `type`. A fitted model adds `prediction_label` and `scores` (map class -> score).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    Classifier,
    DecisionTreeClassifier,
    LinearSVC,
    OneVsRest,
)
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    SQLTransformer,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.ml.evaluate import MOST_CLASSES
from netsight.ml.forest import SparseForestClassifier

# N-gram sizes, vocabulary cap, seed, share of rows held out.
GRAM_SIZES = (3, 4, 5)
VOCABULARY = 50_000
SEED = 42

_CLEAN = r"lower(regexp_replace(url, '\\s\\s+', ' '))"


def _grams_sql() -> str:
    """All substrings of each size; a text shorter than the size has none."""
    parts = [
        f"IF(char_length(text) >= {n}, transform(sequence(1, char_length(text) - {n - 1}), "
        f"i -> substring(text, i, {n})), array())"
        for n in GRAM_SIZES
    ]
    return f"SELECT * EXCEPT (text), concat({', '.join(parts)}) AS grams FROM (SELECT *, {_CLEAN} AS text FROM __THIS__)"


def fit_features(urls: DataFrame, *, vocabulary: int = VOCABULARY, min_docs: int = 1) -> PipelineModel:
    """TF-IDF over lower-cased character n-grams: tf * (ln((1 + n) / (1 + df)) + 1), unit length."""
    grams = SQLTransformer(statement=_grams_sql())
    cut = grams.transform(urls.select("url"))
    counts = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary, minDF=min_docs).fit(cut)
    idf = IDF(inputCol="tf", outputCol="idf").fit(counts.transform(cut)).idf
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol="tf", outputCol="weighted")
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    return PipelineModel([grams, counts, weigh, unit])


def gram_weights(urls: DataFrame, key: str, *, vocabulary: int = VOCABULARY) -> DataFrame:
    """The same features as rows: (key, gram, weight) for the grams in the vocabulary.

    Everything is counted by gram or by (key, gram), so a gram that every URL has is no hot spot.
    Ties at the end of the vocabulary go by gram.
    """
    grams = SQLTransformer(statement=_grams_sql()).transform(urls.select(key, "url"))
    tf = grams.select(key, F.explode("grams").alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    known = (
        tf.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        .orderBy(F.desc("total"), "gram")
        .limit(vocabulary)
        .select("gram", "df")
    )
    docs = urls.agg(F.count(F.lit(1)).alias("docs")).scalar()
    # The limit bounds the vocabulary, so it can go to every task.
    weighed = tf.join(F.broadcast(known), "gram").withColumn(
        "w", F.col("tf") * (F.log((docs + 1) / (F.col("df") + 1)) + 1)
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.select(key, "gram", (F.col("w") / norm).alias("weight"))


def decision_tree(**over) -> Classifier:
    return DecisionTreeClassifier(**{"maxDepth": 25, "minInstancesPerNode": 5, "seed": SEED, **over})


def random_forest(**over) -> Classifier:
    return SparseForestClassifier(**{
        "numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 3, "seed": SEED, "maxMemoryInMB": 1024, **over
    })


def linear_svm(rows: int, *, c: float = 1.0, **over) -> OneVsRest:
    """One against the rest, on the unit-length features as they are; the penalty C on summed losses
    is a regularisation of 1 / (C n) on their mean."""
    svc = LinearSVC(**{
        "regParam": 1.0 / (c * max(rows, 1)), "standardization": False, "tol": 1e-4, "maxIter": 100,
        "weightCol": "weight", **over,
    })
    return OneVsRest(classifier=svc, weightCol="weight", parallelism=4)


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Adds `weight` = n / (classes * n of the class)."""
    counted = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["type"]: r["n"] for r in counted.limit(MOST_CLASSES + 1).collect()}
    if len(sizes) > MOST_CLASSES:
        raise ValueError(f"type has over {MOST_CLASSES} values: these are no classes")
    total, weight = sum(sizes.values()), F.lit(None).cast("double")
    for name, n in sizes.items():
        weight = F.when(F.col("type") == name, total / (len(sizes) * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def fit_classifier(urls: DataFrame, make: Callable[[int], Classifier], *, vocabulary: int = VOCABULARY) -> PipelineModel:
    """Features, class index, classifier and label lookup as one persistable pipeline."""
    # A tree's level shuffles the counts of all its nodes from each partition: as many partitions as there are cores.
    # Fewer would leave cores idle, as rows this short would by their size be one partition.
    known = balanced_weights(urls.filter(F.col("url").isNotNull() & F.col("type").isNotNull()))
    known = known.repartition(urls.sparkSession.sparkContext.defaultParallelism)
    features = fit_features(known, vocabulary=vocabulary)
    index = StringIndexer(inputCol="type", outputCol="label", stringOrderType="alphabetAsc").fit(known)
    train = index.transform(features.transform(known)).select("features", "label", "weight")
    # Every pass of the training reads these rows again.
    train = train.persist()
    try:
        model = make(train.count()).fit(train)
    finally:
        train.unpersist()
    names = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=index.labels)
    return PipelineModel([*features.stages, model, names])


def classes_of(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def score(model: PipelineModel, urls: DataFrame) -> DataFrame:
    """Adds `prediction_label` and `scores`: probabilities where the model has them, else raw scores."""
    out = model.transform(urls)
    vector = "probability" if "probability" in out.columns else "rawPrediction"
    names = F.array(*[F.lit(c) for c in classes_of(model)])
    return out.select(
        *urls.columns, "prediction_label", F.map_from_arrays(names, vector_to_array(vector)).alias("scores")
    )


def rounded(scores: Column, digits: int = 3) -> Column:
    return F.transform_values(scores, lambda _, v: F.round(v, digits))
