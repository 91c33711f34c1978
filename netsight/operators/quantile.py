"""Exact order statistics and running sums over large columns, without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
#: Rows of a part whose running sums one task makes.
PART_ROWS = 100_000


def _cells(values: DataFrame, lo: float, hi: float) -> list:
    """(cell, n, lo, hi) of the values from lo to hi, in order. Both ends have cells of their own, so that
    what is left between them is narrower; rows are counted before they are shuffled."""
    v = F.col("v")
    width = hi / BINS - lo / BINS
    inside = F.floor(v / F.lit(width) - F.lit(lo / width)) if width else F.lit(0)
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(BINS - 1)) + 1
    cell = F.when(v == lo, 0).when(v == hi, BINS + 1).otherwise(inside)
    found = values.filter(v.between(lo, hi)).groupBy(cell.alias("cell"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("cell").collect()


def _neighbours(values: DataFrame, k: int, lo: float, hi: float) -> tuple[float, float | None]:
    """The k-th smallest value (from 0) and the one after it, in one descent: the range that holds the
    k-th is narrowed until it is one value."""
    after = None
    while True:
        cells = _cells(values, lo, hi)
        at = 0
        while k >= cells[at].n:
            k -= cells[at].n
            at += 1
        if at + 1 < len(cells):
            after = cells[at + 1].lo
        if cells[at].lo == cells[at].hi:
            return cells[at].lo, cells[at].lo if k + 1 < cells[at].n else after
        assert (cells[at].lo, cells[at].hi) != (lo, hi), "the range must shrink"
        lo, hi = cells[at].lo, cells[at].hi


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Quantile with linear interpolation between neighbours, over the values that are neither NULL nor
    NaN. Infinite values are the ends of the order; between two that differ, the upper one is taken."""
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    infinite = float("inf")
    finite = F.abs("v") != infinite
    n, low, high, lo, hi = values.agg(
        F.count(F.lit(1)), F.count_if(F.col("v") == -infinite), F.count_if(F.col("v") == infinite),
        F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v"))),
    ).first()
    if n == 0:
        return None
    place = q * (n - 1)
    below, part = int(place), place - int(place)
    if below < low:
        first, second = -infinite, -infinite if below + 1 < low else lo if n > low + high else infinite
    elif below >= n - high:
        first = second = infinite
    else:
        first, second = _neighbours(values.filter(finite), below - low, lo, hi)
        second = infinite if second is None else second
    if part == 0 or first == second:
        return first
    return second if infinite in (abs(first), abs(second)) else first + (second - first) * part


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], *, part_rows: int = PART_ROWS
) -> DataFrame:
    """Adds `cum_<c>` for each column of `sums`: total per keys over rows with a value of `order` at
    least as large. (keys, order) must be unique.

    Each combination of keys has its own value range, cut at approximate quantiles into parts of about
    `part_rows` rows; a part sums on its own and starts from the total of the parts above it.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    most = sizes.agg(F.max("_size")).first()[0] or 0
    parts = -(-most // part_rows)
    if parts > 1:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        edges = df.groupBy(*keys).agg(F.percentile_approx(order, shares, 10 * parts).alias("_edges"))
        named = edges.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_edges")
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        part = F.size(F.filter("_edges", lambda e: F.col(order) > e))
        cut = df.join(named, same).withColumn("_part", part).drop("_edges", *[f"_of_{k}" for k in keys])
    else:
        cut = df.withColumn("_part", F.lit(0))
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    above = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).cast("bigint").alias(c) for c in sums]
    ).withColumn("_row", F.lit(0))
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_row", F.desc(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.withColumn("_row", F.lit(1))
        .unionByName(carried, allowMissingColumns=True)
        .withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums})
        .filter(F.col("_row") == 1)
        .drop("_row", "_part")
    )
