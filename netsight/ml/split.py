"""Stratified train/test split: exact shares, repeatable, no class in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.operators.timeline import repeat_rows
from netsight.session import cut_lineage

#: Distinct rows of a bucket, about: what one task ranks.
_BUCKET_ROWS = 4096


def stratified_split(
    rows: DataFrame, label: str = "type", *, test_share: float = 0.3, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): per class, the rows first in the order of a seeded hash are for training.

    Train gets round((1 - test_share) * n) rows of a class of n, halves rounded up. Equal rows are
    counted, not ranked. The hash order is never sorted as a whole: bucket counts tell which bucket
    of a class holds the cut, and only that bucket is ranked.
    """
    columns = rows.columns
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns], F.lit(str(seed)))
    hashed = (
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hash", F.md5(text))
    )
    hashed = cut_lineage(hashed)
    digits = max(1, math.ceil(math.log(max(2, hashed.count() / _BUCKET_ROWS), 16)))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("_size").over(Window.partitionBy(label))
    # One row per class and bucket.
    buckets = (
        hashed.groupBy(label, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .select(
            F.col(label).alias("_label"),
            F.col("_bucket").alias("_b"),
            "_size",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
            F.floor(size * (1 - test_share) + F.lit(0.5)).alias("_want"),
        )
    )
    placed = hashed.join(
        buckets, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b"))
    ).drop("_label", "_b")
    room = F.col("_want") - F.col("_before")
    cut = (room > 0) & (room < F.col("_size"))
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", *columns)
    upto = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    whole = placed.filter(~cut).withColumn("_train", F.when(room > 0, F.col("_n")).otherwise(0))
    ranked = placed.filter(cut).withColumn("_upto", upto)
    split = ranked.withColumn(
        "_train", F.least(F.col("_n"), F.greatest(room - (F.col("_upto") - F.col("_n")), F.lit(0)))
    ).drop("_upto")
    marked = whole.unionByName(split)

    def take(count: Column) -> DataFrame:
        some = marked.withColumn("_copies", count.cast("bigint")).filter(F.col("_copies") > 0)
        return repeat_rows(some.select(*columns, "_copies"), "_copies")

    return take(F.col("_train")), take(F.col("_n") - F.col("_train"))
