"""Traffic anomaly models: isolation forest, one-class SVM, autoencoder.

Fitted models are small plain objects (trees, weights) sent to tasks; training and scoring run in
tasks over partitions of the data. `score` adds `score` (higher = more normal) and `prediction`
(1 normal, -1 anomaly); the autoencoder's score is its negated error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netsight.operators.quantile import exact_quantile
from netsight.session import cut_lineage


@dataclass
class Scaler:
    """z-scores with the population standard deviation; a constant column is only centred."""

    columns: list[str]
    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        n = len(columns)
        # Twelve digits: what is behind them depends on the order in which partitions are summed.
        exact = [float(f"{v:.12g}") if v is not None else None for v in row]
        return cls(list(columns), [exact[i] or 0.0 for i in range(n)], [exact[n + i] or 1.0 for i in range(n)])

    def transform(self, df: DataFrame) -> DataFrame:
        """The scaled columns under the same names."""
        return df.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.mean, self.std, strict=True)
        })

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.mean)) / np.array(self.std)


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()


class _Model:
    """Scoring shared by the three models: `raw` maps a feature matrix to one number per row."""

    scaler: Scaler
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def add_raw(self, df: DataFrame) -> DataFrame:
        """Adds `score`; a row that lacks a feature has none. Only the features go through Python."""
        columns, scaler, raw = self.scaler.columns, self.scaler, self.raw

        @F.pandas_udf("double")
        def run(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(dtype="float64") for f in features])
            known = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if known.any():
                out[known] = raw(scaler.apply(x[known]))
            return pd.Series(out)

        found = run(*[F.col(c).cast("double") for c in columns])
        return df.withColumn("score", found).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))

    def score(self, df: DataFrame) -> DataFrame:
        """Decision score relative to the threshold, and the label; NULL where a feature is missing."""
        return self.add_raw(df).withColumn("score", F.col("score") - F.lit(self.threshold)).withColumn(
            "prediction", F.when(F.col("score") < 0, -1).when(F.col("score") >= 0, 1)
        )


# Isolation forest -----------------------------------------------------------------------------------


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points in a random binary tree."""
    n = np.asarray(n, dtype="float64")
    big = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


#: About so many distinct rows are ranked in one task.
_BUCKET_ROWS = 4096

_TREE = "tree int, node int, feature int, split double, left int, depth double"


def _grow(seed: int, columns: list[str]):
    """Fit of one tree on its sample: splits at random points until rows are alone or depth runs out."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values(["rank"])[columns].to_numpy(dtype="float64")
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes, queue = [None], [(0, x, 0)]
        while queue:
            at, rows, depth = queue.pop()
            wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if depth >= limit or len(wide) == 0:
                nodes[at] = (tree, at, -1, 0.0, -1, depth + float(_mean_path(len(rows))))
                continue
            f = int(rng.choice(wide))
            split = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left = len(nodes)
            nodes += [None, None]
            nodes[at] = (tree, at, f, split, left, 0.0)
            low = rows[:, f] <= split
            queue += [(left, rows[low], depth + 1), (left + 1, rows[~low], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "depth"])

    return grow


@dataclass
class IsolationForest(_Model):
    trees: int = 100
    contamination: float = 0.01
    sample: int = 256
    seed: int = 42
    scaler: Scaler | None = None
    threshold: float = 0.0
    forest: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    norm: float = 1.0

    def fit(self, df: DataFrame, columns: Sequence[str]) -> IsolationForest:
        columns = list(columns)
        rows = _complete(df, columns)
        self.scaler = Scaler.fit(rows, columns)
        drawn, psi = self._samples(rows, columns)
        drawn = self.scaler.transform(drawn)
        grown = drawn.groupBy("tree").applyInPandas(_grow(self.seed, columns), _TREE).toPandas()
        self.forest = [
            tuple(t.sort_values("node")[c].to_numpy() for c in ("feature", "split", "left", "depth"))
            for _, t in grown.groupby("tree")
        ]
        self.norm = float(_mean_path(np.float64(psi))) or 1.0
        scored = cut_lineage(self.add_raw(rows).select("score"))
        self.threshold = exact_quantile(scored, "score", self.contamination)
        return self

    def _samples(self, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
        """(tree, rank, columns): each tree's rows, drawn from all rows without putting any back.

        Rows stand in the order of a hash, equal ones side by side; a tree draws places in that order.
        Hash buckets are counted, and only buckets that hold a drawn place are ranked. The draw depends
        on the rows and the seed, not on how the rows are partitioned.
        """
        hashed = F.xxhash64(*[F.col(c).cast("string") for c in columns], F.lit(self.seed))
        counted = cut_lineage(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_hash", hashed))
        distinct = counted.count()
        buckets = -(-distinct // _BUCKET_ROWS)
        placed = counted.withColumn("_bucket", F.pmod("_hash", F.lit(buckets or 1)))
        sizes = placed.groupBy("_bucket").agg(F.sum("_n").alias("n")).orderBy("_bucket").collect()
        ends = np.cumsum([r.n for r in sizes], dtype="int64")
        total = int(ends[-1]) if len(ends) else 0
        psi = min(self.sample, total)
        rng = np.random.default_rng(self.seed)
        wanted = []
        for tree in range(self.trees):
            for rank, place in enumerate(rng.choice(total, psi, replace=False) if total else ()):
                at = int(np.searchsorted(ends, place, side="right"))
                wanted.append((tree, rank, int(sizes[at]._bucket), int(place - (ends[at] - sizes[at].n))))
        # trees * sample rows, whatever the number of rows.
        draws = rows.sparkSession.createDataFrame(wanted, "tree int, rank int, _bucket bigint, _place bigint")
        order = Window.partitionBy("_bucket").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, 0)
        upto = placed.join(draws.select("_bucket").distinct(), "_bucket", "left_semi").withColumn("_upto", F.sum("_n").over(order))
        within = (F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n"))
        return upto.join(draws, "_bucket").filter(within).select("tree", "rank", *columns), psi

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, left, depth in self.forest:
            at = np.zeros(len(x), dtype="int64")
            moving = every
            while len(moving):
                node = at[moving]
                f = feature[node]
                inner = f >= 0
                moving, node, f = moving[inner], node[inner], f[inner]
                at[moving] = left[node] + (x[moving, f] > split[node])
            total += depth[at]
        return -np.exp2(-total / (len(self.forest) * self.norm))


# One-class SVM --------------------------------------------------------------------------------------


@dataclass
class OneClassSVM(_Model):
    """RBF one-class SVM on random Fourier features, trained by full-batch subgradient steps.

    Each step is one pass: every partition sums the features of its margin violators.
    """

    nu: float = 0.01
    gamma: float | None = None
    features: int = 128
    steps: int = 40
    seed: int = 42
    scaler: Scaler | None = None
    threshold: float = 0.0
    omega: np.ndarray | None = None
    phase: np.ndarray | None = None
    weights: np.ndarray | None = None

    def _map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.features) * np.cos(x @ self.omega + self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._map(x) @ self.weights

    def fit(self, df: DataFrame, columns: Sequence[str]) -> OneClassSVM:
        columns = list(columns)
        rows = _complete(df, columns)
        self.scaler = Scaler.fit(rows, columns)
        data = cut_lineage(rows)
        n = data.count()
        # 'scale': 1 / (features * variance), and the variance of scaled data is 1.
        gamma = self.gamma if self.gamma is not None else 1.0 / len(columns)
        rng = np.random.default_rng(self.seed)
        self.omega = rng.normal(0.0, np.sqrt(2 * gamma), (len(columns), self.features))
        self.phase = rng.uniform(0.0, 2 * np.pi, self.features)

        self.weights = self._sum(data, columns, None)[0] / n  # mean embedding as the start
        rho = float(self.weights @ self.weights)
        for step in range(1, self.steps + 1):
            violators, count = self._sum(data, columns, rho)
            rate = 1.0 / (step + 1)
            self.weights = (1 - rate) * self.weights + rate * violators / (self.nu * n)
            rho += 0.1 * rate * (1.0 - count / (self.nu * n)) * abs(rho)
        scored = cut_lineage(self.add_raw(data).select("score"))
        self.threshold = exact_quantile(scored, "score", self.nu)
        return self

    def _sum(self, data: DataFrame, columns: list[str], rho: float | None) -> tuple[np.ndarray, int]:
        """Sum of mapped rows (only those below rho, if given) and how many there were."""
        model, scaler, dims = self, self.scaler, self.features

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count = np.zeros(dims), 0
            for batch in batches:
                z = model._map(scaler.apply(batch[columns].to_numpy(dtype="float64")))
                if rho is not None:
                    z = z[z @ model.weights < rho]
                total += z.sum(axis=0)
                count += len(z)
            yield pd.DataFrame({"dim": np.arange(-1, dims), "v": np.r_[float(count), total]})

        sums = data.mapInPandas(part, "dim int, v double").groupBy("dim").agg(F.sum("v").alias("v"))
        by_dim = {r.dim: r.v for r in sums.collect()}
        return np.array([by_dim.get(d, 0.0) for d in range(dims)]), int(by_dim.get(-1, 0.0))


# Autoencoder ----------------------------------------------------------------------------------------


def _init_layers(sizes: Sequence[int], rng: np.random.Generator) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), np.zeros(b)]
    return out


def _forward(params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Activations of all layers: ReLU inside, linear at the end."""
    acts = [x]
    last = len(params) // 2 - 1
    for i in range(last + 1):
        z = acts[-1] @ params[2 * i] + params[2 * i + 1]
        acts.append(z if i == last else np.maximum(z, 0.0))
    return acts


def _gradients(params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    acts = _forward(params, x)
    delta = 2.0 * (acts[-1] - x) / x.size
    grads: list[np.ndarray] = []
    for i in reversed(range(len(params) // 2)):
        grads = [acts[i].T @ delta, delta.sum(axis=0), *grads]
        delta = (delta @ params[2 * i].T) * (acts[i] > 0)
    return grads


def _adam_pass(params: list[np.ndarray], batches: Iterator[np.ndarray], rate: float) -> int:
    """One local pass of Adam over minibatches; changes `params`, returns rows seen."""
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows, step = 0, 0
    for x in batches:
        step += 1
        rows += len(x)
        for p, m, v, g in zip(params, mean, var, _gradients(params, x), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return rows


@dataclass
class Autoencoder(_Model):
    """Dense 16-8-16 network. Each epoch, every partition trains a copy of the weights on its rows
    with Adam, and the copies are averaged, weighted by rows."""

    encoding: int = 16
    epochs: int = 20
    batch: int = 256
    rate: float = 0.001
    percentile: float = 0.95
    seed: int = 42
    scaler: Scaler | None = None
    threshold: float | None = None
    params: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return -np.mean(np.square(_forward(self.params, x)[-1] - x), axis=1)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Autoencoder:
        columns = list(columns)
        rows = _complete(df, columns)
        self.scaler = Scaler.fit(rows, columns)
        data = cut_lineage(rows)
        d, h = len(columns), self.encoding
        self.params = _init_layers([d, h, h // 2, h, d], np.random.default_rng(self.seed))
        for epoch in range(self.epochs):
            self._epoch(data, columns, epoch)
        return self

    def _epoch(self, data: DataFrame, columns: list[str], epoch: int) -> None:
        start, scaler, size, rate, seed = self.params, self.scaler, self.batch, self.rate, self.seed

        def minibatches(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            rng = np.random.default_rng([seed, epoch])
            for batch in batches:
                x = scaler.apply(batch[columns].to_numpy(dtype="float64"))
                x = x[rng.permutation(len(x))]
                yield from (x[i : i + size] for i in range(0, len(x), size))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            local = [p.copy() for p in start]
            rows = _adam_pass(local, minibatches(batches), rate)
            flat = np.concatenate([p.ravel() for p in local]) * rows
            yield pd.DataFrame({"i": np.arange(-1, len(flat)), "v": np.r_[float(rows), flat]})

        sums = data.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        by_i = {r.i: r.v for r in sums.collect()}
        rows = by_i.pop(-1, 0.0)
        if not rows:
            return
        flat, at, new = np.array([by_i[i] for i in range(len(by_i))]) / rows, 0, []
        for p in start:
            new.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        self.params = new

    def errors(self, df: DataFrame) -> DataFrame:
        """Adds `error`: mean squared reconstruction error on the scaled features."""
        return self.add_raw(df).withColumn("error", -F.col("score")).drop("score")

    def score(self, df: DataFrame) -> DataFrame:
        """Rows above the threshold are anomalies; without one, above the 95th percentile of this batch."""
        scored = cut_lineage(self.errors(df))
        cut = self.threshold if self.threshold is not None else exact_quantile(scored, "error", self.percentile)
        return (
            scored.withColumn("score", -F.col("error"))
            .withColumn("prediction", F.when(F.col("error") <= F.lit(cut), 1).when(F.col("error") > F.lit(cut), -1))
            .drop("error")
        )


def split_table(model: _Model, df: DataFrame) -> DataFrame:
    """The first three features of the scored rows with a Normal or Anomaly tag, none where a feature is missing."""
    first = model.scaler.columns[:3]
    tag = F.when(F.col("prediction") == 1, "Normal").when(F.col("prediction") == -1, "Anomaly")
    return model.score(df).select(*first, tag.alias("tag"))
