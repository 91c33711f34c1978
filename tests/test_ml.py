import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from netsight.ml import anomaly, evaluate, forest, registry, split, urls
from netsight.operators import quantile

COLUMNS = ["packet_rate", "unique_port_count", "avg_pkt_size"]


@pytest.fixture(scope="module")
def traffic(spark):
    """Normal traffic with a few rows far outside."""
    rng = np.random.default_rng(3)
    rows = rng.normal([100, 10, 500], [20, 3, 50], (600, 3)).tolist() + [[900.0, 90.0, 1400.0 + i] for i in range(4)]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} double" for c in COLUMNS))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"site{i}.example/{'login?x' if i % 3 == 0 else 'page'}{i}", "phishing" if i % 3 == 0 else "benign") for i in range(90)]
    return spark.createDataFrame(rows, "url string, type string")


def test_quantiles_interpolate(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(0, 1), 4) for _ in range(9000)] + [0.5] * 4000 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None and not math.isnan(v)]
    for q in (0.0, 0.01, 0.5, 0.95, 1.0):
        assert quantile.exact_quantile(df, "v", q) == pytest.approx(np.percentile(known, q * 100), abs=1e-12)
    assert quantile.exact_quantile(df.limit(0), "v", 0.5) is None
    assert quantile.exact_quantile(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v", 0.95) == pytest.approx(2.9)


def test_quantiles_of_odd_columns(spark):
    inf = float("inf")
    columns = {
        "outlier": [1e300, -1e300] + [i / 7 for i in range(6000)],
        "equal": [3.5] * 5000,
        "infinite": [inf] * 50 + [-inf] * 30 + [float(i) for i in range(5000)],
        "only infinite": [inf, inf, -inf],
        "tiny": [5e-324 * i for i in range(5000)],
        "close": [1.0 + i * 2.0**-52 for i in range(5000)],
        "huge": [1.7e308, -1.7e308, 0.0],
    }
    for name, values in columns.items():
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(values)
        for q in (0.0, 0.005, 0.5, 0.99, 1.0):
            at = q * (len(values) - 1)
            a, b = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
            want = a if at == int(at) or a == b else b if inf in (abs(a), abs(b)) else a + (b - a) * (at - int(at))
            assert quantile.exact_quantile(df, "v", q) == want, (name, q)


def test_a_forest_sees_equal_rows_as_often_as_they_are(spark):
    rng = np.random.default_rng(1)
    rows = [[7.0, 3.0, 100.0]] * 6000 + rng.normal([100, 10, 500], [20, 3, 50], (4000, 3)).tolist()
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in COLUMNS))
    forest = anomaly.IsolationForest()
    drawn, psi = forest._samples(df, COLUMNS)
    found = drawn.agg(F.count(F.lit(1)), F.count_if(F.col("packet_rate") == 7.0)).first()
    assert psi == 256 and found[0] == 25600 and abs(found[1] / found[0] - 0.6) < 0.02
    thresholds = [anomaly.IsolationForest(trees=20).fit(df.repartition(n), COLUMNS).threshold for n in (2, 7)]
    assert thresholds[0] == thresholds[1]


def test_rows_without_a_feature_have_no_label(spark, traffic):
    gaps = traffic.unionByName(spark.createDataFrame([(-1, None, 1.0, 2.0), (-2, None, None, None)], traffic.schema))
    for name in ("IsolationForest", "Autoencoder"):
        model = registry.train_behaviour(name, gaps, COLUMNS)
        rows = {r.id: (r.score, r.prediction) for r in model.score(gaps).collect()}
        assert rows[-1] == rows[-2] == (None, None) and sum(p is None for _, p in rows.values()) == 2
        tags = anomaly.split_table(model, gaps).groupBy("tag").count().collect()
        assert {r["tag"] for r in tags} == {"Normal", "Anomaly", None}


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(k, s / 1000, rng.randrange(5)) for k in "ab" for s in rng.sample(range(100000), 700)]
    df = spark.createDataFrame(rows, "k string, s double, n bigint")
    got = quantile.running_totals(df, ["k"], "s", ["n"], part_rows=50).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.cum_n == sum(n for k, s, n in rows if k == r.k and s >= r.s)


def test_grams_as_rows_equal_the_feature_vectors(spark):
    texts = [(0, "AbcABC"), (1, "ab"), (2, "abc  \t de"), (3, "é–ab?x")]
    df = spark.createDataFrame(texts, "id int, url string")
    model = urls.fit_features(df)
    words = model.stages[1].vocabulary
    vectors = model.transform(df).select("id", vector_to_array("features").alias("v")).collect()
    ours = {(r.id, words[i]): w for r in vectors for i, w in enumerate(r.v) if w}
    rows = {(r.id, r.gram): r.weight for r in urls.gram_weights(df, "id").collect()}
    assert ours.keys() == rows.keys() and all(ours[k] == pytest.approx(rows[k]) for k in ours)
    assert (1, "ab") not in rows and (2, "c d") in rows and (0, "abc") in rows


def test_split_is_exact_stratified_and_repeatable(spark):
    rows = [(f"u{i}", "a" if i % 4 else "b") for i in range(1001)] + [("same", "c")] * 5000
    df = spark.createDataFrame(rows, "url string, type string")
    train, test = split.stratified_split(df)
    count = {r.type: r["count"] for r in train.groupBy("type").count().collect()}
    assert count == {"a": 525, "b": 176, "c": 3500}
    assert sorted(train.unionByName(test).collect()) == sorted(df.collect())
    again, _ = split.stratified_split(df.repartition(7))
    other, _ = split.stratified_split(df, seed=1)
    assert sorted(again.collect()) == sorted(train.collect()) != sorted(other.collect())


def scored(spark, rows, classes):
    data = [(t, p, dict(zip(classes, s))) for t, p, *s in rows]
    return spark.createDataFrame(data, "label string, prediction string, scores map<string,double>")


def test_confusion_and_report(spark):
    df = scored(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "a")], "abc")
    matrix = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(df).collect()}
    assert len(matrix) == 9 and sum(matrix.values()) == 5 and matrix["c", "a"] == 2 and matrix["c", "c"] == 0
    rows = {r.name: (round(r.precision, 3), round(r.recall, 3), round(r.f1_score, 3), r.support)
            for r in evaluate.classification_report(df).collect()}
    assert rows["a"] == (0.333, 0.5, 0.4, 2) and rows["b"] == (0.5, 1.0, 0.667, 1) and rows["c"] == (0.0, 0.0, 0.0, 2)
    assert rows["accuracy"] == (0.4, 0.4, 0.4, 5) and rows["macro avg"] == (0.278, 0.5, 0.356, 5)


def test_auc_counts_ordered_pairs(spark):
    rng = random.Random(4)
    rows = [(t, t, 0.0, rng.randrange(20) / 20 + (0.3 if t == "y" else 0)) for t in rng.choices("ny", k=200)]
    df = scored(spark, rows, "ny")
    pos, neg = [r[3] for r in rows if r[0] == "y"], [r[3] for r in rows if r[0] == "n"]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    got = evaluate.auc(df).collect()
    assert [(r.curve, pytest.approx(r.auc)) for r in got] == [("y", want)]
    points = sorted((r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(want)


@pytest.mark.parametrize(("name", "params"), [
    ("DecisionTree", {}), ("RandomForest", {"numTrees": 10, "maxDepth": 10}), ("LinearSVM", {"maxIter": 20}),
])
def test_url_models_learn_store_and_load(spark, labelled, tmp_path, name, params):
    train, test = split.stratified_split(labelled)
    model = registry.train_urls(name, train, **params)
    out = urls.score(model, test)
    assert out.filter("type = prediction_label").count() >= 0.9 * test.count()
    sums = [sum(r.scores.values()) for r in out.collect()]
    if name != "LinearSVM":
        assert all(s == pytest.approx(1) for s in sums)
    registry.save(spark, str(tmp_path), name, model)
    again = registry.load(spark, str(tmp_path), name)
    assert sorted(map(repr, urls.score(again, test).collect())) == sorted(map(repr, out.collect()))


@pytest.mark.parametrize("name", ["IsolationForest", "OneClassSVM", "Autoencoder"])
def test_behaviour_models_flag_the_outliers(spark, traffic, tmp_path, name):
    model = registry.train_behaviour(name, traffic, COLUMNS)
    flagged = {r.id for r in model.score(traffic).filter("prediction = -1").collect()}
    assert {600, 601, 602, 603} <= flagged
    share = 0.05 if name == "Autoencoder" else 0.01
    assert abs(len(flagged) / 604 - share) < 0.005
    registry.save(spark, str(tmp_path), name, model)
    again = registry.load(spark, str(tmp_path), name)
    assert {r.id for r in again.score(traffic).filter("prediction = -1").collect()} == flagged
    tags = anomaly.split_table(model, traffic)
    assert tags.columns == [*COLUMNS, "tag"] and tags.filter("tag = 'Anomaly'").count() == len(flagged)


def test_autoencoder_learns_and_takes_a_threshold(traffic):
    untrained = anomaly.Autoencoder(epochs=0).fit(traffic, COLUMNS)
    trained = anomaly.Autoencoder(epochs=20).fit(traffic, COLUMNS)
    mean = [m.errors(traffic).agg(F.avg("error")).first()[0] for m in (untrained, trained)]
    assert mean[1] < mean[0]
    trained.threshold = float("inf")
    assert trained.score(traffic).filter("prediction = -1").count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    params = [p + rng.normal(size=p.shape) for p in anomaly._init_layers([3, 4, 2, 4, 3], rng)]
    x = rng.normal(size=(5, 3))
    loss = lambda: np.mean(np.square(anomaly._forward(params, x)[-1] - x))
    for p, g in zip(params, anomaly._gradients(params, x)):
        i = tuple(0 for _ in p.shape)
        before = p[i]
        p[i] = before + 1e-6
        up = loss()
        p[i] = before - 1e-6
        down = loss()
        p[i] = before
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_standardise_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = anomaly.Scaler.fit(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_names_versions_and_choice(spark, traffic, tmp_path):
    root = str(tmp_path)
    assert registry.current(spark, root) == "DecisionTree"
    with pytest.raises(registry.UnknownModel):
        registry.choose(spark, root, "KMeans")
    with pytest.raises(registry.UnknownModel):
        registry.train_behaviour("RandomForest", traffic, COLUMNS)
    with pytest.raises(FileNotFoundError):
        registry.load(spark, root, "LinearSVM")
    for name in ("LinearSVM", "Autoencoder"):
        registry.choose(spark, root, name)
    assert registry.current(spark, root) == "Autoencoder"
    for trees in (3, 5):
        registry.save(spark, root, "IsolationForest", anomaly.IsolationForest(trees=trees).fit(traffic, COLUMNS))
    assert len(registry.load(spark, root, "IsolationForest").forest) == 5


def test_training_rows_are_as_many_partitions_as_cores(spark):
    class Stop(Exception):
        pass

    class Looks:
        def fit(self, rows):
            raise Stop(rows.rdd.getNumPartitions())

    rows = spark.createDataFrame([(f"http://a{k}.org/{k * k}", "ab"[k % 2]) for k in range(40)], "url string, type string")
    cores = spark.sparkContext.defaultParallelism
    for given in (rows.coalesce(1), rows.repartition(3 * cores)):
        with pytest.raises(Stop) as found:
            urls.fit_classifier(given, lambda n: Looks())
        assert found.value.args == (cores,)


def sparse_rows(spark, rows, wide, filled, seed=5, classes=3):
    """(label, features) with a few entries a row; the label is in some of them, but for some noise."""
    rng, data = np.random.default_rng(seed), []
    for _ in range(rows):
        at = np.sort(rng.choice(wide, filled, replace=False))
        label = (at[0] % classes if rng.random() < 0.9 else rng.integers(classes)).item()
        data.append((float(label), Vectors.sparse(wide, at.tolist(), rng.random(filled).round(3).tolist())))
    return spark.createDataFrame(data, ["label", "features"])


def trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_a_tree_of_sparse_rows_is_that_of_spark(spark, monkeypatch):
    rows = sparse_rows(spark, 700, 60, 9).repartition(3).persist()
    sure = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 8, "minInstancesPerNode": 3}
    ours, theirs = (kind(**sure).fit(rows) for kind in (forest.SparseForestClassifier, RandomForestClassifier))
    assert ours.totalNumNodes > 30 and trees(ours) == trees(theirs)
    assert (ours.numClasses, ours.numFeatures, ours.uid[:6]) == (3, 60, "Sparse")
    probable = [sorted(m.transform(rows).select("features", vector_to_array("probability")).rdd.map(str).collect()) for m in (ours, theirs)]
    assert probable[0] == probable[1]
    # Another cut into blocks does not matter, nor do dense vectors, nor the way nodes are counted.
    monkeypatch.setattr(forest, "BLOCK_ROWS", 64)
    monkeypatch.setattr(forest, "BLOCK_ENTRIES", 500)
    dense = rows.rdd.map(lambda r: (r.label, Vectors.dense(r.features.toArray()))).toDF(["label", "features"])
    for given in (rows, dense):
        assert trees(forest.SparseForestClassifier(**sure).fit(given)) == trees(ours)
    entropy = {**sure, "impurity": "entropy", "maxBins": 5, "minInfoGain": 0.01}
    ours, theirs = (kind(**entropy).fit(rows) for kind in (forest.SparseForestClassifier, RandomForestClassifier))
    assert trees(ours) == trees(theirs)
    rows.unpersist()


def test_bags_and_drawn_features_of_a_forest(spark):
    rows = sparse_rows(spark, 3000, 400, 12, classes=2).repartition(2)
    model = forest.SparseForestClassifier(numTrees=40, maxDepth=12, seed=7).fit(rows)
    again = forest.SparseForestClassifier(numTrees=40, maxDepth=12, seed=7).fit(rows)
    other = forest.SparseForestClassifier(numTrees=40, maxDepth=12, seed=8).fit(rows)
    assert trees(model) == trees(again) != trees(other) and len(set(trees(model))) == 40
    theirs = RandomForestClassifier(numTrees=40, maxDepth=12, seed=7).fit(rows)
    assert 0.7 < model.totalNumNodes / theirs.totalNumNodes < 1.4
    right = [m.transform(rows).filter("label = prediction").count() / 3000 for m in (model, theirs)]
    assert abs(right[0] - right[1]) < 0.1
    plan = forest.Plan(300, 2, 20, 32, 1, 1.0, True, False, 1, 0.0, np.zeros(400, np.uint8), np.zeros(400, int))
    bag = np.concatenate([plan.bag(3, t, 1000) for t in range(20)])
    assert abs(bag.mean() - 1) < 0.05 and abs((bag == 0).mean() - math.exp(-1)) < 0.02
    drawn = [plan.features(t, p) for t in range(20) for p in range(40)]
    assert all(len(set(d)) == 20 for d in drawn) and np.bincount(np.concatenate(drawn), minlength=400).min() > 10


@pytest.mark.parametrize("lookup", [1, 700, 10**6])
def test_nodes_count_by_column_and_by_row(monkeypatch, lookup):
    monkeypatch.setattr(forest, "_LOOKUP", lookup)
    rng = np.random.default_rng(2)
    n, wide = 400, 90
    bins = np.where(rng.random((n, wide)) < 0.15, rng.integers(1, 6, (n, wide)), 0)
    feature, row = np.nonzero(bins.T)
    labels = rng.integers(0, 3, n)
    block = forest._Rows({
        "labels": labels.astype("<u2"), "ptr": np.concatenate([[0], np.cumsum((bins > 0).sum(axis=0))]).astype("<i4"),
        "rows": row.astype("<u2"), "bins": bins[row, feature].astype("u1"),
    })
    plan = forest.Plan(4, 3, 10, 6, 9, 1.0, True, False, 1, 0.0, np.zeros(wide, np.uint8), np.full(wide, 5))
    runs = np.array([300, 0, 2, 5, 90, 1, 40])
    nodes = np.array([(j % 4, j) for j in range(len(runs))])
    active = np.concatenate([np.sort(rng.choice(n, k, replace=False)) for k in runs]).astype("<u2")
    weights = rng.integers(1, 4, len(active)).astype("u1")
    found = {j.item(): (cells, counts) for j, cells, counts in forest.count_block(plan, block, nodes, active, weights, runs)}
    assert sorted(found) == [0, 2, 3, 4, 5, 6]
    ends = np.cumsum(runs)
    for j, (cells, counts) in found.items():
        want = np.zeros((10, 6, 3), int)
        for r, w in zip(active[ends[j] - runs[j] : ends[j]], weights[ends[j] - runs[j] : ends[j]], strict=True):
            for slot, f in enumerate(plan.features(*nodes[j].tolist())):
                if bins[r, f]:
                    want[slot, bins[r, f], labels[r]] += w
        got = np.zeros(want.size, int)
        got[cells] = counts
        assert (got == want.ravel()).all()


def test_a_wide_row_takes_what_its_entries_take(spark):
    wide = 50_000
    rows = sparse_rows(spark, 600, wide, 30, classes=2).coalesce(1)
    narrow = rows.select("label", F.unwrap_udt("features").alias("v")).select("label", F.col("v.indices").alias("at"), F.col("v.values").alias("value"))
    ends = forest.fit_bins(narrow, 600, 31, 1)
    first = np.concatenate([[0], np.cumsum([len(ends.get(f, ())) for f in range(wide)])])
    flat = np.concatenate([ends[f] for f in sorted(ends)])
    made = narrow.mapInArrow(forest._blocks(flat, first, np.zeros(wide, np.uint8), 32_768, 4_000_000), forest._BLOCK).collect()
    assert len(made) == 1 and len(made[0].labels) == 600 * 2
    assert 600 * 29 < len(made[0].bins) <= 600 * 30 and len(made[0].rows) == 2 * len(made[0].bins)
    assert isinstance(urls.random_forest(), forest.SparseForestClassifier)


def test_thresholds_lie_between_values():
    between = forest.thresholds_of(np.array([0.0, 1.0, 4.0]), np.array([5, 1, 1]), 31)
    assert between.tolist() == [0.5, 2.5]
    many = forest.thresholds_of(np.arange(1000.0), np.ones(1000, int), 31)
    assert len(many) == 31 and np.ptp(np.diff(many)) <= 1
