"""Host statistics whose distinct counts add up: sketches per interval, kept, and united into longer intervals.

Exact distinct counts of an hour cannot be had from those of its minutes. HyperLogLog sketches can be
united, and a row holds at most 2^bits bytes however many peers a host has. The relative standard error
is 1.04 / sqrt(2^bits): 1.6 % for 12 bits. Sums are exact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.functions.timefn import ntz_literal
from netsight.operators.rollup import both_hosts
from netsight.sources.tables import DAY

BITS = 12
SUMS = ("total_packets", "incoming_packets", "outgoing_packets", "total_packets_size")
SKETCHES = ("src_sketch", "port_sketch")


def relative_error(bits: int = BITS) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (bits / 2)


def host_sketches(packets: DataFrame, *, seconds: int = 60, bits: int = BITS) -> DataFrame:
    """Per (interval, host) the sums of host_stats, and sketches of its distinct sources and target ports.

    One shuffle of one row per task, interval and host: a busy host is summed before it, and no flow is
    ever a row. Port 0 and null count as no port; packets without both hosts are left out.
    """
    size = F.coalesce("pkt_len", F.lit(0)).cast("bigint")
    return (
        packets.filter((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
        .select(
            F.window("ts", f"{seconds} seconds").alias("w"), size.alias("bytes"), "src_ip",
            F.nullif(F.col("dst_port").cast("int"), F.lit(0)).alias("dst_port"), F.explode(both_hosts()).alias("h"),
        )
        .groupBy("w", F.col("h")["host_ip"].alias("host_ip"))
        .agg(
            F.count(F.lit(1)).alias("total_packets"), F.sum("h.inc").alias("incoming_packets"),
            F.sum("h.out").alias("outgoing_packets"), F.sum("bytes").alias("total_packets_size"),
            F.hll_sketch_agg("src_ip", bits).alias("src_sketch"), F.hll_sketch_agg("dst_port", bits).alias("port_sketch"),
        )
        .select(F.col("w")["start"].alias("interval_start"), F.col("w")["end"].alias("interval_end"), "host_ip", *SUMS, *SKETCHES)
    )


def _together(rows: DataFrame, by: Sequence) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.hll_union_agg(c).alias(c) for c in SKETCHES]
    )


def merged(sketches: DataFrame) -> DataFrame:
    """Rows with equal interval and host brought together, as of several batches of one interval."""
    return _together(sketches, ["interval_start", "interval_end", "host_ip"])


def united(sketches: DataFrame, *, seconds: int) -> DataFrame:
    """Sketches of longer intervals, a multiple of those given. All must have the same number of bits."""
    rows = _together(sketches, [F.window("interval_start", f"{seconds} seconds").alias("w"), "host_ip"])
    return rows.select(F.col("w")["start"].alias("interval_start"), F.col("w")["end"].alias("interval_end"), "host_ip", *SUMS, *SKETCHES)


def estimated(sketches: DataFrame) -> DataFrame:
    """host_stats with estimated distinct counts, for every question asked of host_stats."""
    return sketches.select(
        "interval_start", "interval_end", "host_ip", "total_packets", "incoming_packets", "outgoing_packets",
        F.hll_sketch_estimate("src_sketch").alias("unique_src_ips"),
        F.hll_sketch_estimate("port_sketch").alias("unique_dst_ports"), "total_packets_size",
    )


def store(sketches: DataFrame, path: str) -> None:
    """Add rows to the sketches kept at `path`, in a folder per day. Rows of an interval that is there
    already add to it, as `united` brings them together."""
    sketches.withColumn(DAY, F.to_date("interval_start")).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def stored(spark: SparkSession, path: str, *, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Sketches kept at `path` whose interval starts in [since, until); only the folders of those days are read."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.filter((F.col(DAY) >= F.lit(since.date())) & (F.col("interval_start") >= ntz_literal(since)))
    if until is not None:
        rows = rows.filter((F.col(DAY) <= F.lit(until.date())) & (F.col("interval_start") < ntz_literal(until)))
    return rows.drop(DAY)
