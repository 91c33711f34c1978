"""Notification throttle: per key, a row passes only if enough time went by since the last that passed.

"Since the last that passed" is a chain, yet it need not be walked by one task. Cut time into blocks
as long as the throttle. At most one row of a block passes, and which one depends only on the offset
from which rows are allowed; the passing row's own offset is the one allowed from in the next block
(0 if none passes). A block is therefore a step function on offsets, and after an empty block
everything is allowed again, so every run of non-empty blocks stands alone. Inside a run, the step
functions of 16 neighbours become one, level by level (up): four rounds of pairs behind one shuffle. Then
the offset each block starts from is handed back down (a parallel prefix scan): a group of 16 is walked
through once in order, with the offset as the only thing to remember. At the top a run is one block,
and everything is allowed at its start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.functions.timefn import MICROS, floor_div, micros
from netsight.session import cut_lineage, ship_package

SINGLE_KEY: tuple[str, ...] = ()

#: Rounds of pairs behind one shuffle, and so blocks of a group.
_ROUNDS = 4
_FAN = 2**_ROUNDS

_RUN = ["_key", "_run", "_len"]
_GROUP = ["_key", "_run", "_group"]
_PAIR = [*_RUN, "_group", "_pair"]


def _compose(steps: DataFrame) -> DataFrame:
    """Steps (_RUN, _group, _idx, upto, out) of blocks -> steps of pairs of blocks, in the same partitions."""
    second = F.col("_idx") % 2 == 1
    rows = steps.select(
        *_RUN, "_group", floor_div(F.col("_idx"), 2).alias("_pair"), "upto",
        F.when(second, F.col("upto")).otherwise(F.col("out")).alias("pos"),
        F.when(second, F.col("out")).alias("value"),
        (~second).alias("probe"),
    )
    # For a probe row: value of the first step whose end is not below the probed offset.
    nearest = Window.partitionBy(*_PAIR).orderBy(F.desc("pos"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    looked_up = F.coalesce(F.last("value", ignorenulls=True).over(nearest), F.lit(0).cast("bigint"))
    joined = rows.withColumn("out", looked_up).filter("probe")
    next_out = F.lead("out").over(Window.partitionBy(*_PAIR).orderBy("upto"))
    return (
        joined.withColumn("_next", next_out)
        .filter(F.col("_next").isNull() | (F.col("_next") != F.col("out")))
        .select(*_RUN, "_group", F.col("_pair").alias("_idx"), "upto", "out")
    )


def _composed(steps: DataFrame) -> DataFrame:
    """Steps of blocks -> steps of groups of blocks. A group's rows are dealt out once."""
    rows = steps.withColumn("_group", floor_div(F.col("_idx"), _FAN)).repartition(*_GROUP)
    for _ in range(_ROUNDS):
        rows = _compose(rows)
    return rows.select(*_RUN, F.col("_group").alias("_idx"), "upto", "out")


def _walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by group and block: first the offset a group starts from, then the steps of its blocks in order."""
    entry, at, following = 0, None, 0
    for frame in frames:
        if not len(frame):
            continue
        idx, upto, out = (frame[c].to_numpy() for c in ("_idx", "upto", "out"))
        same = np.ones(len(frame), bool)
        for c in [*_GROUP, "_idx"]:
            column = frame[c].to_numpy()
            same[1:] &= column[1:] == column[:-1]
        starts = np.flatnonzero(~same)
        starts = np.concatenate([[0], starts[starts > 0]])
        ends = np.append(starts[1:], len(frame))
        found: list[tuple[int, int]] = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            here = (*(frame[c].iat[a] for c in _GROUP), int(idx[a]))
            if here[-1] < 0:
                following, at = int(upto[a]), here
                continue
            if here != at:  # a block may go on over several frames
                at, entry, following = here, following, None
                found.append((a, entry))
            if following is None:
                place = a + int(np.searchsorted(upto[a:b], entry))
                if place < b:
                    following = int(out[place])
        rows, entries = [f[0] for f in found], [f[1] for f in found]
        yield frame[[*_RUN, "_idx"]].iloc[rows].assign(entry=np.array(entries, np.int64))


def _hand_down(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry offsets of groups + steps of their blocks -> entry offsets of the blocks."""
    group, none = floor_div(F.col("_idx"), _FAN), F.lit(0).cast("bigint")
    given = entries.select(
        *_RUN, F.col("_idx").alias("_group"), F.lit(-1).cast("bigint").alias("_idx"), F.col("entry").alias("upto"), none.alias("out")
    )
    rows = steps.select(*_RUN, group.alias("_group"), "_idx", "upto", "out").unionByName(given)
    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "_idx", "upto")
    return dealt.mapInPandas(_walked, "_key string, _run bigint, _len bigint, _idx bigint, entry bigint")


def _run_entries(events: DataFrame, blocks: DataFrame, longest: int, width: int) -> DataFrame:
    """Offset from which each block of the runs of several blocks allows a row."""
    runs = blocks.filter(F.col("_len") > 1)
    index = (F.col("_block") - F.col("_run")).alias("_idx")
    steps = events.join(runs, ["_key", "_block"]).select(*_RUN, index, F.col("_off").alias("upto"), F.col("_off").alias("out"))
    ends = runs.select(*_RUN, index, F.lit(width).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("out"))
    levels = [cut_lineage(steps.unionByName(ends))]
    while _FAN ** len(levels) < longest:
        levels.append(cut_lineage(_composed(levels[-1])))
    zero = F.lit(0).cast("bigint")
    entries = runs.select(*_RUN).distinct().select(*_RUN, zero.alias("_idx"), zero.alias("entry"))
    for level in reversed(levels):
        entries = cut_lineage(_hand_down(level, entries))
    return entries.select("_key", (F.col("_run") + F.col("_idx")).alias("_block"), "entry")


def throttle(
    rows: DataFrame,
    *,
    seconds: float = 300,
    keys: Sequence[str] = SINGLE_KEY,
    ts: str = "ts",
    ties: Sequence[str] = (),
    last_sent: DataFrame | None = None,
) -> DataFrame:
    """The rows that pass. All rows are one line unless `keys` names what has a line of its own.

    Of rows with the same key and time the first by `ties` (default: all columns) can pass.
    `last_sent` (the keys and `last_ts`) carries what passed earlier, see the streaming form.
    """
    ship_package(rows.sparkSession)
    width = int(seconds * MICROS)
    columns = rows.columns
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    # As many salts as a shuffle has tasks.
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    salt = F.pmod(F.xxhash64(*(ties or columns)), F.lit(salts))
    timed = rows.filter(F.col(ts).isNotNull()).select(key.alias("_key"), micros(ts).alias("_us"), *columns)
    if last_sent is not None:
        # One row per key, so this joins at most one row to each; a busy key's rows are spread over salts.
        sent = last_sent.select(key.alias("_key"), micros("last_ts").alias("_sent"), F.explode(every_salt).alias("_salt"))
        open_again = F.col("_sent").isNull() | (F.col("_us") - F.col("_sent") >= width)
        salted = timed.withColumn("_salt", salt)
        timed = salted.join(sent, ["_key", "_salt"], "left").filter(open_again).drop("_sent", "_salt")
    block = floor_div(F.col("_us"), width)
    # Stored, because several passes below read these narrow rows.
    events = cut_lineage(
        timed.select("_key", "_us").distinct()
        .select("_key", "_us", block.alias("_block"), (F.col("_us") - block * width).alias("_off"))
    )
    # One row per key and non-empty block; consecutive ones form a run named by its first block.
    line = Window.partitionBy("_key").orderBy("_block")
    blocks = cut_lineage(
        events.select("_key", "_block").distinct()
        .withColumn("_island", F.col("_block") - F.row_number().over(line))
        .withColumns({
            "_run": F.min("_block").over(Window.partitionBy("_key", "_island")),
            "_len": F.count(F.lit(1)).over(Window.partitionBy("_key", "_island")),
        })
        .drop("_island")
    )
    entries = blocks.filter(F.col("_len") == 1).select("_key", "_block", F.lit(0).cast("bigint").alias("entry"))
    longest = blocks.agg(F.max("_len")).first()[0] or 0
    if longest > 1:
        entries = entries.unionByName(_run_entries(events, blocks, longest, width))
    passing = (
        events.join(entries, ["_key", "_block"])
        .filter(F.col("_off") >= F.col("entry"))
        .groupBy("_key", "_block")
        .agg(F.min("_us").alias("_us"))
    )
    # Rows with the same key and time are spread over salts, in the join as in the choice among them.
    first = F.struct(*(ties or columns))
    chosen = passing.select("_key", "_us", F.explode(every_salt).alias("_salt"))
    return (
        timed.withColumn("_salt", salt)
        .join(chosen, ["_key", "_us", "_salt"])
        .groupBy("_key", "_us", "_salt")
        .agg(F.min_by(F.struct(*columns), first).alias("row"), F.min(first).alias("_first"))
        .groupBy("_key", "_us")
        .agg(F.min_by("row", "_first").alias("row"))
        .select("row.*")
    )
