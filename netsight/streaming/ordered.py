"""Streams whose rows are judged in the order of time: rolling counts, the row before, intervals that close.

Rows wait until the watermark, the newest time seen less a delay, has passed them, so that rows which come
late, but within the delay, still take their place; later ones are dropped. What is judged between
two positions of the watermark goes out once. Waiting rows, and the few past ones that the next need,
are carried from batch to batch as a table, so that the batch operators do the work and a busy key is
split as it is in batch.

When nothing arrives no time passes, and the last rows would wait for ever. With `idle_seconds`, beats of a clock
run beside the input; once there were only beats for that long, everything that waits goes out.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsight.functions.timefn import ntz_literal
from netsight.operators import alerts as alert_ops
from netsight.operators import hosts, rollup, sketches
from netsight.session import cut_lineage
from netsight.streaming import core

BEAT = "_beat"
_CLOCK = "low timestamp_ntz, newest timestamp_ntz, quiet timestamp_ntz, waiting bigint"


def _nothing(rows: DataFrame, high) -> DataFrame:
    return rows.limit(0)


@dataclass
class InOrder:
    """Rows judged in the order of `time`.

    narrow: rows of a batch -> the rows that wait. Their `time` says when the watermark has passed them.
    judge: waiting rows and past ones, up to the watermark -> rows to write, among them those of `judged_by` above
    the watermark's last position. past: rows up to the watermark -> those that later rows need.
    merge: brings equal waiting rows together.
    """

    time: str
    judge: Callable[[DataFrame], DataFrame]
    judged_by: str
    narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows
    past: Callable[[DataFrame, object], DataFrame] = _nothing
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    stamp: str = "ts"
    delay_seconds: float = 10
    idle_seconds: float | None = None

    def start(self, stream: DataFrame, path: str, state: str, checkpoint: str, **run) -> StreamingQuery:
        carried, clock = core.Carried(f"{state}/rows"), core.Carried(f"{state}/clock")

        def write(batch: DataFrame, batch_id: int) -> None:
            self._step(batch, batch_id, carried, clock, path)

        if self.idle_seconds is not None:
            beats = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
            stream = stream.withColumn(BEAT, F.lit(None).cast("timestamp")).unionByName(
                beats.select(F.col("timestamp").alias(BEAT)), allowMissingColumns=True
            )
        return core.start_batches(stream, write, checkpoint, **run)

    def _step(self, batch: DataFrame, batch_id: int, carried: core.Carried, clock: core.Carried, path: str) -> None:
        spark = batch.sparkSession
        beat = F.col(BEAT).cast("timestamp_ntz") if BEAT in batch.columns else F.lit(None).cast("timestamp_ntz")
        given = batch.filter(F.col(BEAT).isNull()).drop(BEAT) if BEAT in batch.columns else batch
        new = cut_lineage(self.narrow(core.to_ntz(given)).filter(F.col(self.time).isNotNull()))
        newest = F.max(F.col(self.stamp).cast("timestamp_ntz"))
        at = batch.agg(newest.alias("newest"), F.max(beat).alias("beat"), F.min(beat).alias("first")).first()
        before, held = clock.before(spark, batch_id), carried.before(spark, batch_id)
        was = before.first() if before is not None else None
        newest = max((t for t in (at["newest"], was and was["newest"]) if t is not None), default=None)
        quiet = None if at["newest"] is not None else (was and was["quiet"]) or at["first"]
        low = was["low"] if was else None
        rows = new if low is None else new.filter(F.col(self.time) > ntz_literal(low))
        rows = rows if held is None else rows.unionByName(held)
        rows = cut_lineage(self.merge(rows))
        last = rows.agg(F.max(self.time)).first()[0]
        high = None if newest is None else newest - dt.timedelta(seconds=self.delay_seconds)
        if quiet is not None and self.idle_seconds is not None and at["beat"] - quiet >= dt.timedelta(seconds=self.idle_seconds):
            high = max((t for t in (newest, last) if t is not None), default=None)
        high = max((t for t in (low, high) if t is not None), default=None)
        if high is None:
            done, rest = None, rows
        else:
            upto = ntz_literal(high)
            done = self.judge(rows.filter(F.col(self.time) <= upto))
            done = done if low is None else done.filter(F.col(self.judged_by) > ntz_literal(low))
            rest = rows.filter(F.col(self.time) > upto).unionByName(self.past(rows.filter(F.col(self.time) <= upto), high))
        rest = cut_lineage(rest)
        waiting = rest.filter(F.col(self.time) > ntz_literal(high)).count() if high is not None else rest.count()
        # A batch of beats that brings nothing writes nothing.
        if done is not None and (high != low or batch_id == 0):
            core.write_batch(done, path, batch_id)
        carried.store(rest, batch_id)
        state = spark.createDataFrame([(high, newest, quiet, waiting)], _CLOCK)
        clock.store(state, batch_id)


def drained(spark: SparkSession, query: StreamingQuery, state: str, *, timeout: float = 600) -> None:
    """Wait until a stream with `idle_seconds` has taken in its files and written all that waited; then stop it."""
    until = time.monotonic() + timeout
    try:
        while time.monotonic() < until and query.isActive:
            number = query.lastProgress and query.lastProgress["batchId"]
            done = core.Carried(f"{state}/clock")
            if number:
                try:
                    now = done.before(spark, number)
                    row = now.first() if now is not None else None
                except Exception as error:  # a version of the clock that a later batch has deleted meanwhile
                    if "PATH_NOT_FOUND" not in str(error) and "FileNotFound" not in str(error):
                        raise
                    row = None
                if row and row["newest"] is not None and row["quiet"] is not None and not row["waiting"]:
                    return
            time.sleep(0.5)
        if query.exception():
            raise query.exception()
        raise TimeoutError("rows still wait")
    finally:
        query.stop()


def host_stats(packets: DataFrame, path: str, state: str, checkpoint: str, *, seconds: int = 60, delay_seconds: float = 10,
               idle_seconds: float | None = 60, **run) -> StreamingQuery:
    """Statistics per (interval, host), each once its interval has closed or nothing has come for `idle_seconds`.

    What waits are flows. Packets of an interval that was written are late.
    """
    flow = [*rollup.FLOW]
    together = lambda rows: rows.groupBy(*flow).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return InOrder(
        "interval_end", rollup.host_stats_of_flows, "interval_end", narrow=lambda p: rollup.flows(p, seconds=seconds),
        merge=together, delay_seconds=delay_seconds, idle_seconds=idle_seconds,
    ).start(packets, path, state, checkpoint, **run)


def host_sketches(packets: DataFrame, path: str, state: str, checkpoint: str, *, seconds: int = 60, bits: int = sketches.BITS,
                  delay_seconds: float = 10, idle_seconds: float | None = 60, **run) -> StreamingQuery:
    """Sums and sketches per (interval, host), each once its interval has closed or nothing has come for
    `idle_seconds`. What waits is one row of bounded size per open interval and host, however many flows there are."""
    return InOrder(
        "interval_end", lambda rows: rows, "interval_end", narrow=lambda p: sketches.host_sketches(p, seconds=seconds, bits=bits),
        merge=sketches.merged, delay_seconds=delay_seconds, idle_seconds=idle_seconds,
    ).start(packets, path, state, checkpoint, **run)


def rolling_type_count(alerts: DataFrame, path: str, state: str, checkpoint: str, *, alert_type: str = alert_ops.DDOS,
                       minutes: int = 10, delay_seconds: float = 10, idle_seconds: float | None = 60, **run) -> StreamingQuery:
    """For every alert, how many of one type fell in the minutes up to it. The frame's alerts are carried."""
    return InOrder(
        "ts", lambda rows: alert_ops.rolling_type_count(rows, alert_type=alert_type, minutes=minutes, ordered=False), "ts",
        narrow=lambda a: a.select("ts", "alert_type"),
        past=lambda rows, high: rows.filter((F.col("ts") >= ntz_literal(high) - F.expr(f"interval {minutes} minutes")) & (F.col("alert_type") == alert_type)),
        delay_seconds=delay_seconds, idle_seconds=idle_seconds,
    ).start(alerts, path, state, checkpoint, **run)


def rolling_packets(stats: DataFrame, path: str, state: str, checkpoint: str, *, minutes: int = 30, delay_seconds: float = 10,
                    idle_seconds: float | None = 60, **run) -> StreamingQuery:
    """Packets per host over the minutes up to each interval's end."""
    return InOrder(
        "interval_end", lambda rows: _rolling(rows, minutes), "interval_end",
        narrow=lambda s: s.select("host_ip", "interval_end", "total_packets"),
        past=lambda rows, high: rows.filter(F.col("interval_end") >= ntz_literal(high) - F.expr(f"interval {minutes} minutes")),
        stamp="interval_end", delay_seconds=delay_seconds, idle_seconds=idle_seconds,
    ).start(stats, path, state, checkpoint, **run)


def _rolling(rows: DataFrame, minutes: int) -> DataFrame:
    far = 100 * 365 * 24  # hours: every row is in the look-back
    return hosts.rolling_packets(rows, as_of="2000-01-01 00:00:00", hours=far, minutes=minutes, ordered=False)


def new_source_spike(stats: DataFrame, path: str, state: str, checkpoint: str, *, min_jump: int = 2, delay_seconds: float = 10,
                     idle_seconds: float | None = 60, **run) -> StreamingQuery:
    """Intervals in which a host saw at least min_jump more sources than in its interval before, however long
    ago; the last interval of each host is carried."""

    def past(rows: DataFrame, high) -> DataFrame:
        # The row that the next one follows: of one interval, the one with most sources is the last in order.
        last = F.struct("interval_start", "unique_src_ips", "interval_end")
        return rows.groupBy("host_ip").agg(F.max(last).alias("r")).select("host_ip", "r.*").select(*rows.columns)

    return InOrder(
        "interval_end", lambda rows: _spikes(rows, min_jump), "interval_end",
        narrow=lambda s: s.select("host_ip", "interval_start", "interval_end", "unique_src_ips").distinct(),
        past=past, merge=lambda rows: rows.distinct(), stamp="interval_end", delay_seconds=delay_seconds, idle_seconds=idle_seconds,
    ).start(stats, path, state, checkpoint, **run)


def _spikes(rows: DataFrame, min_jump: int) -> DataFrame:
    found = hosts.new_source_spike(rows, as_of="2000-01-01 00:00:00", hours=100 * 365 * 24, min_jump=min_jump)
    ends = rows.select("host_ip", "interval_start", "interval_end").distinct()
    return found.join(ends, ["host_ip", "interval_start"])


def quiet_periods(alerts: DataFrame, path: str, state: str, checkpoint: str, *, min_minutes: float = 10, delay_seconds: float = 10,
                  idle_seconds: float | None = 60, **run) -> StreamingQuery:
    """Pauses between consecutive alerts of at least so many minutes; the last alert's time is carried."""
    return InOrder(
        "ts", lambda rows: alert_ops.quiet_periods(rows, min_minutes=min_minutes), "gap_end",
        narrow=lambda a: a.select("ts").distinct(), merge=lambda rows: rows.distinct(),
        past=lambda rows, high: rows.agg(F.max("ts").alias("ts")).filter("ts is not null"),
        delay_seconds=delay_seconds, idle_seconds=idle_seconds,
    ).start(alerts, path, state, checkpoint, **run)
