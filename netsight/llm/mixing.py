"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; within its source, documents are
taken in the order of their keys until the words taken reach the budget. A source whose target is beyond
its size is first taken whole, as often as it fits, and only the rest is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsight.llm.common import words
from netsight.session import cut_lineage

#: Digits of a document's hash that make its uniform draw: 52 bits, exact in a double.
DRAW_DIGITS = 13
#: Documents of a source are ranked in slices of about so many.
SLICE = 1024
#: Equal rows of the slice that is ranked go on as one; afterwards they are dealt out by so many.
CHUNK = 1024


def uniform_draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of a text's characters that are neither signs nor capitals, squared."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(text, "#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    share = plain / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), share * share)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with `target`: the words that each source is to give.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes. A target
    stops at `most` times the source's size; the excess goes to the others by weight until none is above.
    That is the level at which the capped and the uncapped sources together give the sum: a source is
    capped if it is below its share when all sources that are capped at a lower level are.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    # One row per source: the windows see the list of sources, not the documents.
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(rest)
    stepped = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # The first uncapped source has the level of all that follow; theirs, reckoned as if it were capped, are lower.
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything.partitionBy())
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * common)
    return stepped.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 42,
    weight: Column | None = None,
) -> DataFrame:
    """(key, source, size, source_size, target, epochs, taken) of every row: the words that the mix takes.

    size is the number of words, 0 for a null or empty text, which the mix takes 0 of. Sources are taken
    `epochs` times whole, then in the order of the sampling keys as long as that brings the source nearer
    to its target: so the last document may go beyond it by up to half its size. Sampling keys depend on
    the document's key, its text and the seed only, so that reruns agree and rows that share a key (or
    have none) spread over the slices; rows equal in key and text have one sampling key, are ranked as one
    with their number, and are equally good. A null source is a source of its own. An empty table gives an
    empty one.
    """
    weight = quality_weight(F.col(text)) if weight is None else weight
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("bigint").alias("size"),
        weight.alias("weight"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
    )
    named = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    sized = sized.withColumn("drawn", -F.log(uniform_draw(named, seed)) / F.col("weight")).drop("digest")
    sized = cut_lineage(sized)
    sizes = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("weight").alias("least")
    )
    sizes = cut_lineage(sizes)
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    targets = targets.join(sizes.select(F.col("source").alias("s"), "n", "least"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("bigint"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Slices of keys, from small to large. By the least weight, no slice expects more than SLICE rows times
    # the largest weight over the least.
    slices = F.ceil(F.col("n") / SLICE).cast("bigint")
    part = F.floor((1 - F.exp(-F.col("drawn") * F.col("least"))) * F.col("slices")).cast("bigint")
    targets = cut_lineage(targets.withColumn("slices", slices).withColumnRenamed("source", "s"))
    rows = sized.drop("weight").join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("slice", part)
    sums = rows.groupBy("source", "slice", "budget").agg(F.sum("size").alias("sum"))
    upward = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut_lineage(sums.withColumn("before", F.coalesce(F.sum("sum").over(upward), F.lit(0))))
    cut = sums.where("before < budget and before + sum >= budget").select(
        F.col("source").alias("s"), F.col("slice").alias("cut"), F.col("before")
    )
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = (F.col("slice") == F.col("cut")) & (F.col("size") > 0)
    in_order = Window.partitionBy("source").orderBy("drawn", F.col("key").isNull(), "key", "size")
    # Equal rows, be they a third of all, are one row here, summed before the shuffle.
    alike = rows.where(inside).groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    words_of = F.col("size") * F.col("copies")
    alike = alike.withColumn(
        "seen", F.col("before") + F.sum(words_of).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - words_of
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    chunks = alike.withColumn("chunk", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(CHUNK).cast("bigint"))))
    last = F.least(F.col("chunk") + CHUNK, F.col("copies")) - 1
    ranked = chunks.repartition("key", "drawn", "chunk").withColumn("nth", F.explode(F.sequence(F.col("chunk"), last, one)))
    ranked = ranked.withColumn("seen", F.col("seen") + F.col("nth") * F.col("size"))
    nearer = F.col("seen") + F.col("size") / 2 <= F.col("budget")
    ranked = ranked.withColumn("extra", F.when((F.col("seen") < F.col("budget")) & nearer, 1).otherwise(0))
    ranked = ranked.drop("copies", "seen", "chunk", "nth")
    whole = rows.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "extra", F.when(F.col("cut").isNull(), F.when(F.col("budget") > 0, 1).otherwise(0)).when(F.col("slice") < F.col("cut"), 1).otherwise(0)
    )
    return ranked.unionByName(whole).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "epochs",
        (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"),
    )
