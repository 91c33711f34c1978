"""Hard negatives by exact scores: matrix products in a residue number system.

Vectors of integers are multiplied modulo several small primes in single precision, where every partial
sum stays below 2^24 and is exact; Chinese remaindering gives the signed scores back. Anchors and rows
are dealt into tiles of a block of anchors and a block of rows. A first pass over the rows of an
anchor's label finds its positives, a second one over the rows of other labels the best scores in the
window below each positive's score; a tile keeps only so many per anchor, and Spark ranks what tiles keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsight.llm.common import type_of
from netsight.session import cut_lineage, ship_package

#: The largest prime, and the bound under which whole numbers and their sums are exact in single precision.
LARGEST, EXACT = 251, 1 << 24
#: Rows and anchors of a tile at most (about); rows that a task multiplies at a time.
ROWS, ANCHORS, CHUNK = 1 << 16, 1 << 11, 1 << 10
#: Stands for a null id in orders: null comes last.
LAST = (1 << 63) - 1


def primes(bound: int) -> list[int]:
    """The largest primes up to LARGEST whose product tells all whole numbers from -bound to bound apart."""
    found, product = [], 1
    for n in range(LARGEST, 1, -1):
        if product > 2 * bound:
            break
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
    return found


def _residues(numbers: np.ndarray, p: int) -> np.ndarray:
    """Of least size, so between -p / 2 and p / 2."""
    return ((numbers + p // 2) % p - p // 2).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact; scores that do not fit a long are an error."""
    size = a.shape[1]
    largest = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    bound = size * largest[0] * largest[1]
    if bound > LAST:
        raise ValueError("scores may not fit a long")
    out, modulus = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes(bound):
        x, y = _residues(a, p), _residues(b, p)
        step = EXACT // (p // 2) ** 2 - 1
        rest = np.zeros(out.shape, np.float32)
        for at in range(0, size, step):
            part = x[:, at : at + step] @ y[:, at : at + step].T
            rest = np.fmod(rest + np.fmod(part, np.float32(p)), np.float32(p))
        # A further digit in mixed radix, of least size: the sum is the signed score once the primes suffice.
        digit = (rest.astype(np.int64) - out % p) * pow(modulus, -1, p)
        digit = (digit + p // 2) % p - p // 2
        with np.errstate(over="ignore"):  # what wraps on the way wraps back: the score itself fits
            out += digit * np.int64((modulus + (1 << 63)) % (1 << 64) - (1 << 63))
        modulus *= p
    return out


class _Best:
    """For anchors and slots, the first `keep` rows by score, id and mark whose score lies in the slot's window."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low.copy(), high, keep
        self.held = [np.empty(0, np.int64) for _ in range(5)]

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        for slot in range(self.low.shape[1]):
            low, high = self.low[:, slot, None], self.high[:, slot, None]
            anchor, row = np.nonzero(allowed & (scores >= low) & (scores <= high))
            if len(anchor):
                new = [anchor, np.full(len(anchor), slot), -scores[anchor, row], ids[row], marks[row]]
                self.held = [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort(self.held[::-1])
        self.held = [x[order] for x in self.held]
        anchor, slot, score = self.held[:3]
        group = anchor * self.low.shape[1] + slot
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        last = place == self.keep - 1
        self.low[anchor[last], slot[last]] = -score[last]
        self.held = [x[place < self.keep] for x in self.held]


def whole(vectors: np.ndarray, times: int) -> np.ndarray:
    numbers = np.floor(times * vectors)
    if np.abs(numbers).max(initial=0) >= 1 << 53:
        raise ValueError("components are too large for whole numbers")
    return numbers.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _long(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


class _Tile:
    """The anchors of a tile, and what has been found for them so far."""

    def __init__(self, batches: list[pa.RecordBatch], same: bool, keep: int, times: int, window: tuple[int, int]):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.ids, self.marks = _long(rows.column("id")), rows.column("mark").to_numpy()
        self.labels, self.same = rows.column("code").to_numpy(), same
        self.numbers = whole(_matrix(rows.column("vector")), times)
        if same:
            low, high = np.full((len(self.ids), 1), -LAST), np.full((len(self.ids), 1), LAST)
        else:
            counts = rows.column("scores").value_lengths().to_numpy()
            high = np.full((len(self.ids), counts.max()), -LAST)
            high[np.arange(high.shape[1]) < counts[:, None]] = rows.column("scores").flatten().to_numpy()
            low = np.where(high == -LAST, LAST, 0)
            # Rounded up to the least whole score in the window; below zero the window is empty.
            real = high != -LAST
            low[real] = [-(-window[0] * s // window[1]) if s >= 0 else LAST for s in high[real].tolist()]
        self.best = _Best(low, high, keep)

    def meet(self, rows: pa.RecordBatch, times: int) -> None:
        at, step = 0, 64  # small at first, so that thresholds are there before much is held
        while at < rows.num_rows:
            part = rows.slice(at, step)
            ids, marks, codes = _long(part.column("id")), part.column("mark").to_numpy(), part.column("code").to_numpy()
            scores = product(self.numbers, whole(_matrix(part.column("vector")), times))
            if self.same:
                allowed = (self.ids[:, None] != ids) | (self.marks[:, None] != marks)
            else:
                allowed = self.labels[:, None] != codes
            self.best.add(scores, allowed, ids, marks)
            at, step = at + step, min(4 * step, CHUNK)

    def found(self) -> pa.RecordBatch:
        anchor, slot, score, ids, marks = self.best.held
        ids = pa.array(ids, mask=ids == LAST)
        anchors = pa.array(self.ids[anchor], mask=self.ids[anchor] == LAST)
        columns = [anchors, pa.array(self.marks[anchor]), pa.array(slot.astype(np.int32)), pa.array(-score), ids, pa.array(marks)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "anchor_mark", "slot", "score", "id", "mark"])


FOUND = "anchor bigint, anchor_mark bigint, slot int, score bigint, id bigint, mark bigint"


def _tiles(anchors: DataFrame, rows: DataFrame, same: bool, keep: int, blocks: tuple[int, int], times: int, window: tuple[int, int]) -> DataFrame:
    """What each tile finds: at most `keep` rows per anchor and slot (a positive, or the only slot)."""
    count = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(F.lit(n), "mark", "id"), F.lit(n)).cast("int")
    group = F.col("code") if same else F.lit(0).cast("bigint")
    shape = ["group", "size", "i", "j", "kind", "id", "mark", "code", "vector", "scores"]
    left = anchors.withColumns({"kind": F.lit(0), "i": dealt(blocks[0])}).withColumn("j", count(blocks[1]))
    right = rows.withColumns({"kind": F.lit(1), "j": dealt(blocks[1]), "scores": F.lit(None).cast("array<bigint>")})
    right = right.withColumn("i", count(blocks[0]))
    both = [x.withColumns({"group": group, "size": F.size("vector")}).select(*shape) for x in (left, right)]
    tiles = both[0].unionByName(both[1]).repartition("group", "size", "i", "j")
    tiles = tiles.sortWithinPartitions("group", "size", "i", "j", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, tile = None, [], None
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in ("group", "size", "i", "j", "kind")]
            changes = sum((np.diff(c, prepend=c[:1]) != 0 for c in columns), np.zeros(batch.num_rows, bool))
            starts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                *here, kind = (c[a] for c in columns)
                if here != key:
                    if tile:
                        yield tile.found()
                    key, waiting, tile = here, [], None
                if kind == 0:
                    waiting.append(batch.slice(a, b - a))
                elif waiting or tile:
                    if not tile:
                        tile = _Tile(waiting, same, keep, times, window)
                    tile.meet(batch.slice(a, b - a), times)
        if tile:
            yield tile.found()

    return tiles.mapInArrow(run, FOUND)


def _first(found: DataFrame, keep: int, *of: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("mark")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("rank") <= keep)


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, times: int = 256, window: tuple[int, int] = (4, 5),
) -> DataFrame:
    """For each anchor and positive, the different-label rows scored highest from window[0] / window[1] of the
    positive's score up to it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on rows. A score is the inner product of floor(times * component). An anchor's positives
    are the first other rows of its label. Higher scores come first, ties by smaller key, null last, then by
    a hash of the row. Rows whose label or vector is null, or that hold a null or non-finite component, take
    no part. Equal rows (key, label, vector) count once; rows that share a key only are rows of their own.
    Vectors of different sizes have no score. A window below zero is empty; an anchor without positives
    or negatives gives no row, so does an empty table. Other columns are not read. Scores that may
    not fit a long, and components from 2^53 / times on, are an error.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks")
    )
    rows = rows.where(F.col("label").isNotNull() & usable(F.col("vector"))).distinct()
    rows = rows.withColumns({"mark": F.xxhash64("label", "vector"), "code": F.xxhash64("label")})
    if type_of(rows, "label") in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("code", F.col("label").cast("bigint"))
    rows = cut_lineage(rows.drop("label"))
    anchors, rows = rows.where("asks").drop("asks"), rows.drop("asks")
    # Small tables get as many blocks of rows as there are partitions, so that all tasks have work.
    blocks = (anchors.count() // ANCHORS + 1, max(rows.count() // ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    near = _tiles(asked, rows, True, positives, blocks, times, window)
    near = _first(near, positives, "anchor", "anchor_mark")
    chosen = F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("s"), F.col("id").alias("p"))))
    near = cut_lineage(near.groupBy("anchor", "anchor_mark").agg(chosen.alias("chosen")))
    same = anchors["id"].eqNullSafe(near["anchor"]) & (anchors["mark"] == near["anchor_mark"])
    asked = cut_lineage(anchors.join(near, same).drop("anchor", "anchor_mark"))
    far = _tiles(asked.withColumn("scores", F.col("chosen.s")).drop("chosen"), rows, False, negatives, blocks, times, window)
    far = _first(far, negatives, "anchor", "anchor_mark", "slot")
    same = far["anchor"].eqNullSafe(asked["id"]) & (far["anchor_mark"] == asked["mark"])
    found = far.join(asked.select(F.col("id"), F.col("mark"), "chosen"), same)
    positive = F.element_at("chosen", F.col("slot") + 1)
    return found.select(
        far["anchor"].alias("anchor_id"), positive["p"].alias("positive_id"), far["rank"], far["id"].alias("negative_id"),
        positive["s"].alias("positive_score"), far["score"].alias("negative_score"),
    )
