"""Random forest over sparse rows: Spark's classifier and its model, trained without rows of full width.

Spark's own training keeps each row as one number per feature (4 bytes times 50,000 n-grams) and counts every drawn feature
of every row. Here a block of rows keeps its non-zero entries by column; what a node counts is found in the columns of
its drawn features, the zeros by subtraction. Trees, bags, bins, gains and the pruning are defined as in Spark; the
random numbers are others.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.session import delete, scratch_path, ship_package

#: Most rows and entries of a block: what a task holds at a time. Rows are numbered in 16 bits.
BLOCK_ROWS = 8_192
BLOCK_ENTRIES = 1_000_000
#: Rows that show where a feature's bins end, at least; as in Spark.
_BIN_ROWS = 10_000
#: Cells of counts, and nodes, that are summed together at most.
_CELLS = 2_000_000
_NODES = 64
#: Entries of the table that tells for small nodes which features are drawn; a quarter as many are looked up at a time.
_LOOKUP = 8_000_000
#: Rows of a block's trees that are summed up at a time.
_PIECE = 1_000_000

_BLOCK = "block bigint, labels binary, ptr binary, rows binary, bins binary"
_STATE = f"{_BLOCK}, active binary, weights binary, runs binary"
_COUNTS = "bucket: int, totals: binary, cells: binary, counts: binary"
_BEST = "node int, feature int, bin int, gain double, total binary, low binary"


@dataclass(frozen=True)
class Plan:
    """What tasks know of the forest. `zero` and `splits`: per feature, the bin of 0 and the number of thresholds."""

    trees: int
    classes: int
    drawn: int
    bins: int
    seed: int
    rate: float
    bootstrap: bool
    entropy: bool
    least_rows: int
    least_gain: float
    zero: np.ndarray
    splits: np.ndarray

    @property
    def cells(self) -> int:
        return self.drawn * self.bins * self.classes

    @property
    def bucket(self) -> int:
        """Nodes that are summed together."""
        return max(1, min(_NODES, _CELLS // self.cells))

    def features(self, tree: int, place: int) -> np.ndarray:
        """The features drawn for a node, the same in every task."""
        n = len(self.zero)
        if self.drawn >= n:
            return np.arange(n)
        return np.sort(np.random.default_rng([self.seed, 1, tree, place]).choice(n, self.drawn, replace=False))

    def bag(self, block: int, tree: int, rows: int) -> np.ndarray:
        """How often the tree has each row of a block."""
        rng = np.random.default_rng([self.seed, 0, block, tree])
        if self.bootstrap:
            return rng.poisson(self.rate, rows).astype(np.uint8)
        return (rng.random(rows) < self.rate).astype(np.uint8)

    def impurity(self, counts: np.ndarray) -> np.ndarray:
        """Of class counts in the last axis; 0 without rows. Summed class by class as in Spark, so that ties end alike."""
        n = counts.sum(axis=-1)
        out = np.where(n > 0, 0.0 if self.entropy else 1.0, 0.0)
        for c in range(self.classes):
            share = counts[..., c] / np.maximum(n, 1)
            out = out - share * (np.log(np.where(share > 0, share, 1)) / np.log(2) if self.entropy else share)
        return out


# Bins -----------------------------------------------------------------------------------------------


def thresholds_of(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Ends of a feature's bins, from its distinct values in order: between all of them, or one about each stride."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    found, seen = [], np.cumsum(counts)
    stride = target = seen[-1] / (most + 1)
    for i in range(1, len(values)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found[:most])


def _thresholds(rows: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(feature, value) of the non-zero entries, in this order -> thresholds of each feature."""

    def of(feature: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(np.diff(feature)) + 1
        ids, out = [], []
        for mine, its in zip(np.split(feature, ends), np.split(value, ends), strict=True):
            values, counts = np.unique(its, return_counts=True)
            if len(its) < rows:
                at = np.searchsorted(values, 0.0)
                values, counts = np.insert(values, at, 0.0), np.insert(counts, at, rows - len(its))
            ids.append(int(mine[0]))
            out.append(thresholds_of(values, counts, most).astype("<f8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["feature", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, value = np.zeros(0, "int32"), np.zeros(0)
        for batch in batches:
            feature = np.concatenate([feature, batch.column("feature").to_numpy(zero_copy_only=False)])
            value = np.concatenate([value, batch.column("value").to_numpy(zero_copy_only=False)])
            # The last feature may go on in the next batch.
            whole = int(np.searchsorted(feature, feature[-1])) if len(feature) else 0
            if whole:
                yield of(feature[:whole], value[:whole])
                feature, value = feature[whole:], value[whole:]
        if len(feature):
            yield of(feature, value)

    return run


def fit_bins(entries: DataFrame, rows: int, most: int, seed: int) -> dict[int, np.ndarray]:
    """Thresholds per feature from some ten thousand rows; features without any are constant there."""
    wanted = max((most + 1) ** 2, _BIN_ROWS)
    some = entries if rows <= wanted else entries.sample(wanted / rows, seed)
    shown = rows if rows <= wanted else some.count()
    pairs = some.select(F.explode(F.arrays_zip("at", "value")).alias("e")).select(F.col("e.at").alias("feature"), F.col("e.value"))
    ordered = pairs.filter("value <> 0").repartition("feature").sortWithinPartitions("feature", "value")
    found = ordered.mapInArrow(_thresholds(shown, most), "feature int, ends binary").collect()
    return {r.feature: np.frombuffer(r.ends, "<f8") for r in found if r.ends}


# Blocks ---------------------------------------------------------------------------------------------


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _blocks(ends: np.ndarray, first: np.ndarray, zero: np.ndarray, rows_most: int, entries_most: int):
    """Rows (label, at, value) -> blocks of their entries by column; entries in the bin of 0 are left out."""

    def binned(feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first threshold that is not below, by bisection in each feature's part of `ends`."""
        low, high = first[feature], first[feature + 1]
        base = low.copy()
        while len(todo := np.flatnonzero(low < high)):
            half = (low[todo] + high[todo]) // 2
            below = ends[half] < value[todo]
            low[todo[below]] = half[below] + 1
            high[todo[~below]] = half[~below]
        return (low - base).astype(np.uint8)

    def block(number: int, labels: list, sizes: list, features: list, bins: list) -> dict:
        size, feature, b = np.concatenate(sizes), np.concatenate(features), np.concatenate(bins)
        row = np.repeat(np.arange(len(size), dtype=np.uint16), size)
        order = np.argsort(feature, kind="stable")
        ptr = np.zeros(len(zero) + 1, np.int32)
        np.cumsum(np.bincount(feature, minlength=len(zero)), out=ptr[1:])
        made = (np.concatenate(labels).astype("<u2"), ptr, row[order], b[order])
        return dict(zip(("labels", "ptr", "rows", "bins"), (x.tobytes() for x in made), strict=True)) | {"block": number}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, entries, parts = TaskContext.get().partitionId() << 32, 0, 0, ([], [], [], [])
        schema = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("labels", "ptr", "rows", "bins")]])

        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            at, value = batch.column("at"), batch.column("value")
            offsets = at.offsets.to_numpy().astype(np.int64)
            feature = at.values.to_numpy(zero_copy_only=False)
            value = value.values.slice(value.offsets[0].as_py()).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(label):
                room = int(np.searchsorted(offsets, offsets[start] + entries_most - entries, "right")) - 1 - start
                n = min(len(label) - start, rows_most - rows, max(room, 0 if rows else 1))
                if n > 0:
                    a, z = offsets[start], offsets[start + n]
                    f, size = feature[a:z], np.diff(offsets[start : start + n + 1])
                    b = binned(f, value[a - offsets[0] : z - offsets[0]])
                    keep = b != zero[f]
                    row = np.repeat(np.arange(n), size)[keep]
                    for part, x in zip(parts, (label[start : start + n], np.bincount(row, minlength=n), f[keep], b[keep]), strict=True):
                        part.append(x)
                    rows, entries, start = rows + n, entries + int(z - a), start + n
                if start < len(label):
                    yield pa.RecordBatch.from_pylist([block(number, *parts)], schema)
                    number, rows, entries, parts = number + 1, 0, 0, ([], [], [], [])
        if rows:
            yield pa.RecordBatch.from_pylist([block(number, *parts)], schema)

    return run


# Levels ---------------------------------------------------------------------------------------------


class _Rows:
    """A block's entries by column and, if asked for, by row."""

    def __init__(self, of: dict):
        read = lambda name, kind: np.frombuffer(of[name], kind)
        self.labels, self.ptr = read("labels", "<u2"), read("ptr", "<i4").astype(np.int64)
        self.rows, self.bins = read("rows", "<u2"), read("bins", "u1")
        self._by_row = None

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each row begins, features, bins)"""
        if self._by_row is None:
            order = np.argsort(self.rows, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(self.rows, minlength=len(self.labels)))])
            feature = np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), np.diff(self.ptr))
            self._by_row = starts, feature[order], self.bins[order]
        return self._by_row

    def goes_left(self, rows: np.ndarray, feature: int, last: int, zero: int) -> np.ndarray:
        """Which rows have a bin up to `last`."""
        a, z = self.ptr[feature], self.ptr[feature + 1]
        low = np.full(len(self.labels), zero <= last)
        low[self.rows[a:z]] = self.bins[a:z] <= last
        return low[rows]


def _summed(cell: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and the sums of their weights."""
    if size <= 8 * len(cell):
        sums = np.bincount(cell, weights=weight, minlength=size)
        found = np.flatnonzero(sums)
        return found, sums[found].astype(np.int64)
    found, place = np.unique(cell, return_inverse=True)
    return found, np.bincount(place, weights=weight, minlength=len(found)).astype(np.int64)


def count_block(plan: Plan, block: _Rows, nodes: np.ndarray, active: np.ndarray, weights: np.ndarray, runs: np.ndarray):
    """(node's place in the level, cells, counts) for the nodes that have rows here.

    A large node goes through the columns of its features; small ones together go through their rows' entries.
    """
    c, at, ends = plan.classes, np.zeros(len(block.labels), np.uint8), np.cumsum(runs)
    entries_a_row, small, entries = len(block.rows) / max(1, len(block.labels)), [], 0
    together = max(1, _LOOKUP // len(plan.zero))
    slots = None
    for j in np.flatnonzero(runs):
        mine, its = active[ends[j] - runs[j] : ends[j]], weights[ends[j] - runs[j] : ends[j]]
        features = plan.features(*nodes[j].tolist())
        starts, sizes = block.ptr[features], block.ptr[features + 1] - block.ptr[features]
        if sizes.sum() > len(mine) * entries_a_row:
            if slots is None:
                slots = np.full(min(together, len(runs)) * len(plan.zero), -1, np.int32)
            small.append((j, features, mine, its))
            entries += len(mine) * entries_a_row
            if len(small) == together or entries >= _LOOKUP // 4:
                yield from _count_by_row(plan, block, small, slots)
                small, entries = [], 0
            continue
        at[mine] = its
        entry = _ranges(starts, sizes)
        weight = at[block.rows[entry]]
        hit = np.flatnonzero(weight)
        at[mine] = 0
        slot = np.repeat(np.arange(plan.drawn), sizes)[hit]
        entry = entry[hit]
        cell = (slot * plan.bins + block.bins[entry]) * c + block.labels[block.rows[entry]]
        yield j, *_summed(cell, weight[hit], plan.cells)
    if small:
        yield from _count_by_row(plan, block, small, slots)


def _count_by_row(plan: Plan, block: _Rows, taken: list[tuple], slots: np.ndarray):
    """The same for some nodes at a time; `slots`, for (node, feature), is -1 before and after."""
    n, wide = len(taken), len(plan.zero)
    starts, feature, bins = block.by_row()
    keys = np.concatenate([k * wide + f for k, (_, f, _, _) in enumerate(taken)])
    slots[keys] = np.tile(np.arange(plan.drawn, dtype=np.int32), n)
    row = np.concatenate([x[2] for x in taken]).astype(np.int64)
    node = np.repeat(np.arange(n), [len(x[2]) for x in taken])
    size = starts[row + 1] - starts[row]
    entry = _ranges(starts[row], size)
    line = np.repeat(np.arange(len(row)), size)
    slot = slots[node[line] * wide + feature[entry]]
    slots[keys] = -1
    hit = np.flatnonzero(slot >= 0)
    line, entry = line[hit], entry[hit]
    cell = ((node[line] * plan.drawn + slot[hit]) * plan.bins + bins[entry]) * plan.classes + block.labels[row[line]]
    cells, counts = _summed(cell, np.concatenate([x[3] for x in taken])[line], n * plan.cells)
    cut = np.searchsorted(cells, np.arange(n + 1) * plan.cells)
    for k, (j, *_) in enumerate(taken):
        yield j, cells[cut[k] : cut[k + 1]] - k * plan.cells, counts[cut[k] : cut[k + 1]]


def _level(plan: Plan, nodes: np.ndarray, splits: np.ndarray | None):
    """Blocks -> blocks whose rows have gone on to `nodes` (tree, place), with what each bucket of nodes counts there.

    splits: per node of the level before, (feature, bin, left goes on, right goes on); none at the roots.
    """

    def begin(block: _Rows, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bags = [plan.bag(number, t, len(block.labels)) for t in range(plan.trees)]
        rows = [np.flatnonzero(b).astype("<u2") for b in bags]
        weights = np.concatenate([b[r] for b, r in zip(bags, rows, strict=True)])
        return np.concatenate(rows), weights, np.array([len(r) for r in rows])

    def move(block: _Rows, active: np.ndarray, weights: np.ndarray, runs: np.ndarray):
        moved, kept, sizes, ends = [active[:0]], [weights[:0]], [], np.cumsum(runs)
        for (feature, last, *on), end, n in zip(splits.tolist(), ends, runs, strict=True):
            if not any(on):
                continue
            mine, its = active[end - n : end], weights[end - n : end]
            low = block.goes_left(mine, feature, last, int(plan.zero[feature])) if n else np.zeros(0, bool)
            for side in [x for x, goes in zip((low, ~low), on, strict=True) if goes]:
                moved.append(mine[side])
                kept.append(its[side])
                sizes.append(len(moved[-1]))
        return np.concatenate(moved), np.concatenate(kept), np.array(sizes)

    def counted(block: _Rows, active: np.ndarray, weights: np.ndarray, runs: np.ndarray) -> list[dict]:
        c, size = plan.classes, plan.bucket
        cell, sums = np.repeat(np.arange(len(runs), dtype=np.int32) * c, runs), np.zeros(len(runs) * c)
        cell += block.labels[active]
        for at in range(0, len(cell), _PIECE):
            piece = slice(at, at + _PIECE)
            sums += np.bincount(cell[piece], weights=weights[piece], minlength=len(sums))
        totals = sums.astype("<i8").reshape(-1, c)
        found: dict[int, tuple[list, list]] = {}
        for j, cells, counts in count_block(plan, block, nodes, active, weights, runs):
            keys, numbers = found.setdefault(int(j) // size, ([], []))
            keys.append((cells + (j % size) * plan.cells).astype("<i4"))
            numbers.append(counts.astype("<i4"))
        none = ([np.zeros(0, "<i4")],) * 2
        out = []
        for b in np.unique(np.flatnonzero(runs) // size).tolist():
            keys, numbers = (np.concatenate(x).tobytes() for x in found.get(b, none))
            out.append({"bucket": b, "totals": totals[b * size : (b + 1) * size].tobytes(), "cells": keys, "counts": numbers})
        return out

    counts = pa.list_(pa.struct([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("totals", "cells", "counts")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                of = {n: batch.column(n)[i].as_py() if n == "block" else batch.column(n)[i].as_buffer() for n in names}
                block = _Rows(of)
                if splits is None:
                    active, weights, runs = begin(block, of["block"])
                else:
                    active, weights, runs = move(
                        block, np.frombuffer(of["active"], "<u2"), np.frombuffer(of["weights"], "u1"), np.frombuffer(of["runs"], "<i4")
                    )
                of |= {"active": active.tobytes(), "weights": weights.tobytes(), "runs": runs.astype("<i4").tobytes()}
                fixed = ("block", "labels", "ptr", "rows", "bins")
                columns = [batch.column(n).slice(i, 1) for n in fixed] + [pa.array([of[n]], pa.binary()) for n in ("active", "weights", "runs")]
                columns.append(pa.array([counted(block, active, weights, runs)], counts))
                yield pa.RecordBatch.from_arrays(columns, [*fixed, "active", "weights", "runs", "counted"])

    return run


def best_split(plan: Plan, features: np.ndarray, counts: np.ndarray, total: np.ndarray) -> tuple[int, int, float, np.ndarray]:
    """(feature or -1, last bin on the left, gain, class counts on the left), from counts per (feature, bin, class) without zeros."""
    counts = counts.reshape(plan.drawn, plan.bins, plan.classes)
    counts[np.arange(plan.drawn), plan.zero[features]] += total - counts.sum(axis=1)
    low = np.cumsum(counts, axis=1)[:, :-1]
    n_low, n = low.sum(axis=-1), int(total.sum())
    open_ = np.arange(plan.bins - 1) < plan.splits[features][:, None]
    open_ &= (n_low >= plan.least_rows) & (n - n_low >= plan.least_rows)
    if not open_.any():
        return -1, 0, 0.0, total
    left, right = low[open_], total - low[open_]
    gain = plan.impurity(total) - n_low[open_] / n * plan.impurity(left) - (n - n_low[open_]) / n * plan.impurity(right)
    k = int(np.argmax(gain))
    slot, last = (int(x[k]) for x in np.nonzero(open_))
    if gain[k] <= 0 or gain[k] < plan.least_gain:
        return -1, 0, 0.0, total
    return int(features[slot]), last, float(gain[k]), left[k]


def _best(plan: Plan, nodes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by bucket, in the order of buckets -> the best split of each of their nodes."""

    def of(bucket: int, sums: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        rows = []
        for k, total in enumerate(totals):
            j = bucket * plan.bucket + k
            features = plan.features(*nodes[j].tolist())
            feature, last, gain, low = best_split(plan, features, sums[k * plan.cells : (k + 1) * plan.cells], total)
            rows.append((j, feature, last, gain, total.astype("<i8").tobytes(), low.astype("<i8").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
        names = ["node", "feature", "bin", "gain", "total", "low"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, totals = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                part, cells, counts = (
                    np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in (("totals", "<i8"), ("cells", "<i4"), ("counts", "<i4"))
                )
                if bucket != now:
                    if now is not None:
                        yield of(now, sums, totals)
                    now, totals = bucket, np.zeros((len(part) // plan.classes, plan.classes), np.int64)
                    sums = np.zeros(len(totals) * plan.cells, np.int64)
                totals += part.reshape(totals.shape)
                sums[cells] += counts
        if now is not None:
            yield of(now, sums, totals)

    return run


# Trees ----------------------------------------------------------------------------------------------


@dataclass(slots=True, eq=False)
class Node:
    tree: int
    depth: int
    place: int
    counts: np.ndarray | None = None
    feature: int = -1
    threshold: float = 0.0
    gain: float = -1.0
    left: Node | None = None
    right: Node | None = None


def grow(blocks: DataFrame, plan: Plan, ends: dict[int, np.ndarray], depth: int) -> list[Node]:
    """All trees level by level: each level is one pass over the blocks, which carry the rows of each node on.

    The blocks of a level are stored in the shared folder until the next ones are, so that no plan grows with the levels.
    """
    spark = blocks.sparkSession
    roots = [Node(t, 0, 0) for t in range(plan.trees)]
    level, state, splits, stored = roots, blocks, None, []
    try:
        while level:
            nodes = np.array([(n.tree, n.place) for n in level], np.int64)
            stored.append(scratch_path(spark, "level"))
            state.mapInArrow(_level(plan, nodes, splits), f"{_STATE}, counted array<struct<{_COUNTS}>>").write.parquet(stored[-1])
            while len(stored) > 1:
                delete(spark, stored.pop(0))
            state = spark.read.schema(f"{_STATE}, counted array<struct<{_COUNTS}>>").parquet(stored[-1])
            each = state.select(F.explode("counted").alias("c")).select("c.*")
            found = each.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_best(plan, nodes), _BEST).collect()
            state = state.drop("counted")
            level, splits = _next_level(level, found, plan, ends, depth)
    finally:
        for path in stored:
            delete(spark, path)
    return roots


def _next_level(level: list[Node], found: list, plan: Plan, ends: dict[int, np.ndarray], depth: int) -> tuple[list[Node], np.ndarray]:
    """The children that are to be split, and how the rows get there. Places count on over the level: left, then right."""
    splits, after = np.zeros((len(level), 4), np.int64), []
    splits[:, 0] = -1
    for r in sorted(found, key=lambda r: r.node):
        node = level[r.node]
        node.counts = np.frombuffer(r.total, "<i8")
        if r.feature < 0 or node.depth >= depth:
            continue
        low = np.frombuffer(r.low, "<i8")
        node.feature, node.gain, node.threshold = r.feature, r.gain, float(ends[r.feature][r.bin])
        node.left, node.right = (Node(node.tree, node.depth + 1, 0, counts) for counts in (low, node.counts - low))
        on = []
        for child in (node.left, node.right):
            # Pure, too deep, or too small to be cut: a leaf.
            on.append(child.depth < depth and np.count_nonzero(child.counts) > 1 and child.counts.sum() >= 2 * plan.least_rows)
            if on[-1]:
                child.place = len(after) + 1 + (child.depth << 32)
                after.append(child)
        splits[r.node] = (r.feature, r.bin, *on)
    for node in level:
        if node.counts is None:
            node.counts = np.zeros(plan.classes, np.int64)
    return after, splits


def _rows_of(root: Node, plan: Plan) -> Iterator[tuple]:
    """A tree's nodes numbered from the root, left before right. Leaves of one parent that say the same become one."""
    ordered, todo = [], [root]
    while todo:
        ordered.append(node := todo.pop())
        if node.left:
            todo += [node.right, node.left]
    said, size = {}, {}
    for node in reversed(ordered):
        said[id(node)], size[id(node)] = int(np.argmax(node.counts)), 1
        if node.left:
            if not (node.left.left or node.right.left) and said[id(node.left)] == said[id(node.right)]:
                node.left = node.right = None
            else:
                size[id(node)] += size[id(node.left)] + size[id(node.right)]
    todo = [(0, root)]
    while todo:
        at, node = todo.pop()
        left, right = (at + 1, at + 1 + size[id(node.left)]) if node.left else (-1, -1)
        if node.left:
            todo += [(right, node.right), (left, node.left)]
        yield (
            node.tree, at, float(said[id(node)]), float(plan.impurity(node.counts)), node.counts.astype(float).tolist(), int(node.counts.sum()),
            node.gain if node.left else -1.0, left, right, node.feature if node.left else -1, [node.threshold] if node.left else [],
        )


_NODE_COLUMNS = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
    "leftChild int, rightChild int, featureIndex int, leftCategoriesOrThreshold array<double>"
)


def to_model(spark: SparkSession, estimator: RandomForestClassifier, roots: list[Node], plan: Plan) -> RandomForestClassificationModel:
    """Spark's model of these trees, by way of the form in which it stores models."""
    given = {p.name: v for p, v in estimator._paramMap.items()}
    usual = {p.name: v for p, v in estimator._defaultParamMap.items()}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": given, "defaultParamMap": usual}
    top = about | {
        "class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "uid": estimator.uid,
        "numFeatures": len(plan.zero), "numClasses": plan.classes, "numTrees": plan.trees,
    }
    tree_params = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
                   "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "probabilityCol",
                   "rawPredictionCol", "seed"}
    tree = about | {k: {n: v for n, v in about[k].items() if n in tree_params} for k in ("paramMap", "defaultParamMap")}
    tree["class"] = "org.apache.spark.ml.classification.DecisionTreeClassificationModel"
    path = scratch_path(spark, "forest")
    try:
        spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        trees = [(t, json.dumps(tree | {"uid": f"dtc_{estimator.uid}_{t}"}), 1.0) for t in range(plan.trees)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        nodes = spark.createDataFrame([r for root in roots for r in _rows_of(root, plan)], _NODE_COLUMNS)
        split = F.struct("featureIndex", "leftCategoriesOrThreshold", F.lit(-1).alias("numCategories")).alias("split")
        node = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split)
        nodes.select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
        return RandomForestClassificationModel.load(path)
    finally:
        delete(spark, path)


def _drawn(how: str, wide: int, trees: int) -> int:
    """Features drawn for a node."""
    known = {"all": wide, "sqrt": np.ceil(np.sqrt(wide)), "log2": np.ceil(np.log2(wide)), "onethird": np.ceil(wide / 3)}
    if how == "auto":
        how = "all" if trees == 1 else "sqrt"
    if how in known:
        return max(1, int(known[how]))
    return max(1, min(wide, int(how) if how.isdigit() else int(np.ceil(float(how) * wide))))


class SparseForestClassifier(RandomForestClassifier):
    """Spark's random forest, trained as above. Row weights, leaf numbers, classes of features and over 255 bins are left to Spark."""

    def _others(self, dataset: DataFrame) -> bool:
        get = self.getOrDefault
        attributes = dataset.schema[get("featuresCol")].metadata.get("ml_attr", {}).get("attrs", {})
        return bool(
            (self.isSet("weightCol") and get("weightCol")) or get("leafCol") or get("minWeightFractionPerNode") > 0 or get("maxBins") > 255
            or {"nominal", "binary"} & set(attributes)
        )

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark, get = dataset.sparkSession, self.getOrDefault
        vector = F.unwrap_udt(get("featuresCol"))
        rows = dataset.select(F.col(get("labelCol")).cast("double").alias("label"), vector.alias("v")).select(
            "label",
            F.coalesce("v.size", F.size("v.values")).alias("size"),
            F.coalesce("v.indices", F.transform("v.values", lambda _, i: i)).alias("at"),
            F.col("v.values").alias("value"),
        )
        seen = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.max("label").alias("last"), F.max("size").alias("wide"), F.sum(F.size("at")).alias("entries")
        ).first()
        if self._others(dataset) or not seen.rows or not seen.last or not seen.wide:
            return super()._fit(dataset)
        ship_package(spark)
        bins = min(get("maxBins"), seen.rows)
        ends = fit_bins(rows.select("at", "value"), seen.rows, bins - 1, get("seed") % 2**31)
        sizes, zero = np.zeros(seen.wide, np.int64), np.zeros(seen.wide, np.uint8)
        for f, e in ends.items():
            sizes[f], zero[f] = len(e), np.searchsorted(e, 0.0)
        plan = Plan(
            trees=get("numTrees"), classes=int(seen.last) + 1, drawn=_drawn(get("featureSubsetStrategy"), seen.wide, get("numTrees")), bins=bins,
            seed=get("seed") % 2**63, rate=get("subsamplingRate"), bootstrap=get("bootstrap"), entropy=get("impurity") == "entropy",
            least_rows=get("minInstancesPerNode"), least_gain=get("minInfoGain"), zero=zero, splits=sizes,
        )
        flat = np.concatenate([ends[f] for f in sorted(ends)]) if ends else np.zeros(0)
        first = np.concatenate([[0], np.cumsum(sizes)])
        # No more than about a block a partition.
        parts = max(-(-seen.rows // BLOCK_ROWS), -(-seen.entries // BLOCK_ENTRIES))
        narrow = rows.select("label", "at", "value")
        dealt = narrow.repartition(parts) if parts > narrow.rdd.getNumPartitions() else narrow
        blocks = dealt.mapInArrow(_blocks(flat, first, zero, BLOCK_ROWS, BLOCK_ENTRIES), _BLOCK)
        return to_model(spark, self, grow(blocks, plan, ends, get("maxDepth")), plan)
