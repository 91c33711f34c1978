"""Ordered-time building blocks whose tasks stay bounded however the rows are spread.

A window over one long time line, or over one busy host, would be a single task. Each helper cuts
the line into short slots, aggregates inside the slots before any shuffle of rows, and carries what a
slot needs from earlier ones in as one extra row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.functions.timefn import MICROS, floor_div, micros

COPIES = "_copies"
CHUNK = 65_536


def repeat_rows(df: DataFrame, copies: str, *, number: str | None = None) -> DataFrame:
    """Each row `copies` times. A row with very many copies is spread over the cluster in chunks.

    `number` names a column for the number of the copy, which tells the copies apart in a sort.
    """
    kept = [c for c in df.columns if c != copies]
    chunks = F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1, F.lit(CHUNK).cast("bigint"))
    size = F.least(F.lit(CHUNK).cast("bigint"), F.col(copies) - F.col("_at")).cast("int")
    rows = (
        df.filter(F.col(copies) > 0)
        .withColumn("_at", F.explode(chunks))
        .withColumn("_len", size)
        .drop(copies)
        .hint("rebalance")
        .select(*kept, "_at", F.posexplode(F.array_repeat(F.lit(0), F.col("_len"))))
    )
    return rows.select(*kept, *([(F.col("_at") + F.col("pos")).alias(number)] if number else []))


def rolling_total(df: DataFrame, ts: str, frame_seconds: int, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct (keys, ts): sum of `value` over rows in [ts - frame, ts], both ends in, peers in.

    Columns: keys, ts, total (NULL when the frame has no value), _copies (input rows with that ts).

    Rows without a time are peers of each other and of nothing else.

    Rows first collapse to one per (keys, ts). A value enters at its ts and leaves right after
    ts + frame, so the total at any moment is a running sum of entries minus exits. The running sum
    restarts every second from a base: the sum of the whole seconds still inside the frame. A task
    thus sees at most one second of one key, that is at most a million distinct microseconds.
    """
    keys = list(keys)
    if frame_seconds < 1 or frame_seconds != int(frame_seconds):
        raise ValueError("the frame must be a whole number of seconds")
    # Rows without a time have no slot: they are one row of their own, which no other meets.
    per_ts = (
        df.groupBy(*keys, ts)
        .agg(F.sum(value).alias("v"), F.count(value).alias("m"), F.count(F.lit(1)).alias(COPIES))
        .withColumn("_us", micros(ts))
    )
    slot = floor_div(F.col("_us"), MICROS)
    line = [*keys, "_slot", "_us", "_phase", "v", "m", ts, COPIES]

    def step(phase: int, us: Column, sign: int) -> Column:
        return F.struct(
            F.lit(phase).alias("_phase"), us.alias("_us"), (F.col("v") * sign).alias("v"), (F.col("m") * sign).alias("m")
        )

    steps = F.array(step(1, F.col("_us"), 1), step(2, F.col("_us") + frame_seconds * MICROS, -1))
    moves = (
        per_ts.select(*keys, ts, COPIES, F.explode(steps).alias("s"))
        .select(*keys, ts, COPIES, "s.*")
        .filter((F.col("_phase") == 1) | ((F.col("m") != 0) & F.col("_us").isNotNull()))
        .withColumn("_slot", slot)
        .select(*line)
    )

    # Base of a second: total of the `frame` whole seconds before it. Spans of several frames are
    # worked on alone, each with a copy of the last frame of the span before.
    span = 8 * frame_seconds
    # The same columns as above are read, though not all are needed: so both use one shuffle.
    per_slot = per_ts.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(
        F.sum("v").alias("v"), F.sum("m").alias("m"), F.max(ts).alias(ts), F.max(COPIES).alias(COPIES)
    )
    home = floor_div(F.col("_slot"), span)
    into_next = floor_div(F.col("_slot") + frame_seconds, span)
    before = Window.partitionBy(*keys, "_span").orderBy("_slot").rangeBetween(-frame_seconds, -1)
    base = (
        per_slot.withColumn("_home", home)
        .withColumn("_span", F.explode(F.array_distinct(F.array(home, into_next))))
        .withColumns({"v": F.sum("v").over(before), "m": F.sum("m").over(before)})
        .filter((F.col("_span") == F.col("_home")) & F.col("v").isNotNull())
        .withColumns({"_us": F.col("_slot") * MICROS, "_phase": F.lit(0)})
        .select(*line)
    )

    running = Window.partitionBy(*keys, "_slot").orderBy("_us", "_phase").rowsBetween(Window.unboundedPreceding, 0)
    return (
        moves.unionByName(base)
        .withColumns({"total": F.sum("v").over(running), "_m": F.sum("m").over(running)})
        .filter(F.col("_phase") == 1)
        .select(*keys, ts, F.when(F.col("_m") > 0, F.col("total")).alias("total"), COPIES)
    )


def previous_value(
    df: DataFrame,
    ts: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    *,
    span_seconds: int = 3600,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Adds `previous`: struct of `values` from the row before, per keys in the order (ts, ties).

    The lag runs inside spans of `span_seconds`; the last row of the nearest earlier span that has
    rows is carried in as the row before the span's first. One summary row per span is all that is
    ever ordered across spans.
    """
    keys, order = list(keys), ["_us", *ties]
    lined = df.withColumn("_us", micros(ts)).withColumn("_span", floor_div(F.col("_us"), span_seconds * MICROS))
    tails = lined.groupBy(*keys, "_span").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    next_span = F.lead("_span").over(Window.partitionBy(*keys).orderBy("_span"))
    carried = tails.withColumn("_span", next_span).filter(F.col("_span").isNotNull())
    rows = lined.withColumn("_last", F.struct(*values)).withColumn("_row", F.lit(1))
    both = rows.unionByName(carried.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_span").orderBy("_row", *order)
    return (
        both.withColumn("previous", F.lag("_last").over(inside))
        .filter(F.col("_row") == 1)
        .drop("_us", "_span", "_last", "_row")
    )


def bursts(df: DataFrame, ts: str, key: str, gap_seconds: float, min_rows: int) -> DataFrame:
    """Runs of rows of one key with no pause longer than the gap; runs shorter than min_rows go.

    Two rows in the same gap-wide bin are always in the same run, so rows collapse to one per
    (key, bin) before the shuffle and a key costs at most time span / gap rows.
    """
    gap = int(gap_seconds * MICROS)
    bins = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(key, floor_div(micros(ts), gap).alias("_bin"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    )
    line = Window.partitionBy(key).orderBy("_bin")
    pause = micros("first") - F.lag(micros("last")).over(line)
    opens = F.when(pause.isNull() | (pause > gap), 1).otherwise(0)
    return (
        bins.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(line))
        .groupBy(key, "_run")
        .agg(F.min("first").alias("burst_start"), F.max("last").alias("burst_end"), F.sum("n").alias("n"))
        .filter(F.col("n") >= min_rows)
        .drop("_run")
    )


def silences(df: DataFrame, ts: str, min_seconds: float) -> DataFrame:
    """Pauses of at least min_seconds between consecutive rows: gap_start, gap_end, silence_seconds.

    Rows in one bin of that width are closer than the width, so only the edges of bins matter.
    """
    width = int(min_seconds * MICROS)
    bins = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(floor_div(micros(ts), width).alias("_bin"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    )
    span = max(3600, int(4096 * min_seconds))
    gap_start = F.col("previous")["last"]
    return (
        previous_value(bins, "first", ["last"], span_seconds=span)
        .select(
            gap_start.alias("gap_start"),
            F.col("first").alias("gap_end"),
            (micros("first") - micros(gap_start)).alias("_us"),
        )
        .filter(F.col("_us") >= width)
        .select("gap_start", "gap_end", (F.col("_us") / F.lit(float(MICROS))).alias("silence_seconds"))
    )


def mean_gap_seconds(ts: str) -> Column:
    """Mean pause between consecutive rows: the pauses add up to max - min, so no ordering is needed."""
    pauses = F.count(ts) - 1
    return (F.max(micros(ts)) - F.min(micros(ts))) / F.when(pauses > 0, pauses) / F.lit(float(MICROS))
