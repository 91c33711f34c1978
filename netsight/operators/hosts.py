"""Questions asked of the host_stats table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.functions.derive import ratio
from netsight.functions.timefn import since, trunc
from netsight.operators import timeline

AsOf = dt.datetime | str | None


def top_bandwidth(stats: DataFrame, *, as_of: AsOf = None, minutes: float = 100_000, limit: int = 5) -> DataFrame:
    return (
        since(stats, "interval_end", as_of, dt.timedelta(minutes=minutes))
        .groupBy("host_ip")
        .agg(F.sum("total_packets_size").alias("bytes_last_10m"), F.sum("total_packets").alias("pkts_last_10m"))
        .orderBy(F.desc_nulls_first("bytes_last_10m"), "host_ip")
        .limit(limit)
    )


def avg_packet_size(stats: DataFrame) -> DataFrame:
    return (
        stats.groupBy("host_ip")
        .agg(F.sum("total_packets_size").alias("bytes"), F.sum("total_packets").alias("total_pkts"))
        .select(
            "host_ip",
            ratio(F.col("bytes"), F.col("total_pkts"), digits=None, null_as_zero=False).alias("avg_pkt_size_bytes"),
            "total_pkts",
        )
        .orderBy(F.desc_nulls_first("avg_pkt_size_bytes"), "host_ip")
    )


def heavy_outgoing(
    stats: DataFrame,
    *,
    as_of: AsOf = None,
    hours: float = 2,
    factor: float = 1,
    null_ratio_as_zero: bool = True,
) -> DataFrame:
    """Hosts that sent at least `factor` times what they received."""
    return (
        since(stats, "interval_end", as_of, dt.timedelta(hours=hours))
        .groupBy("host_ip")
        .agg(F.sum("incoming_packets").alias("in_pkts"), F.sum("outgoing_packets").alias("out_pkts"))
        .filter(F.col("out_pkts") >= factor * F.col("in_pkts"))
        .withColumn(
            "out_in_ratio", ratio(F.col("out_pkts"), F.col("in_pkts"), null_as_zero=null_ratio_as_zero)
        )
        .orderBy(F.desc_nulls_first("out_in_ratio"), "host_ip")
    )


def port_fan_out(stats: DataFrame, *, as_of: AsOf = None, hours: float = 2, min_ports: int = 10) -> DataFrame:
    return (
        since(stats, "interval_end", as_of, dt.timedelta(hours=hours))
        .filter(F.col("unique_dst_ports") >= min_ports)
        .select("interval_start", "interval_end", "host_ip", "unique_dst_ports")
        .orderBy(F.desc("unique_dst_ports"), "host_ip", "interval_start")
    )


def new_source_spike(stats: DataFrame, *, as_of: AsOf = None, hours: float = 12, min_jump: int = 2) -> DataFrame:
    """Intervals in which a host saw at least min_jump more sources than in its interval before.

    Only intervals inside the look-back count as a predecessor. Equal rows never differ from each
    other, so they collapse to one before the shuffle, which bounds what a busy host can hold.
    """
    if min_jump < 1:
        raise ValueError("min_jump must be at least 1")
    seen = (
        since(stats, "interval_end", as_of, dt.timedelta(hours=hours))
        .select("host_ip", "interval_start", "unique_src_ips")
        .distinct()
    )
    prev = F.col("previous")["unique_src_ips"]
    return (
        timeline.previous_value(
            seen, "interval_start", ["unique_src_ips"], ["host_ip"], ties=["unique_src_ips"]
        )
        .select("host_ip", "interval_start", "unique_src_ips", prev.alias("prev_src_ips"))
        .withColumn("new_src_jump", F.col("unique_src_ips") - F.col("prev_src_ips"))
        .filter(F.col("new_src_jump") >= min_jump)
        .orderBy(F.desc("new_src_jump"), "host_ip", "interval_start")
    )


def rolling_packets(
    stats: DataFrame, *, as_of: AsOf = None, hours: float = 24, minutes: int = 30, ordered: bool = True
) -> DataFrame:
    """Packets per host over the minutes up to each interval's end, one row per interval."""
    recent = since(stats, "interval_end", as_of, dt.timedelta(hours=hours))
    totals = timeline.rolling_total(recent, "interval_end", minutes * 60, F.col("total_packets"), ["host_ip"])
    rows = timeline.repeat_rows(totals, timeline.COPIES, number="_n").withColumnRenamed("total", "pkts_last_30m")
    return (rows.orderBy("host_ip", "interval_end", "_n") if ordered else rows).drop("_n")


def hourly_heatmap(stats: DataFrame) -> DataFrame:
    return (
        stats.groupBy(trunc("hour", "interval_start").alias("hour_bucket"), "host_ip")
        .agg(F.sum("total_packets").alias("pkts"), F.sum("total_packets_size").alias("bytes"))
        .orderBy(F.desc("hour_bucket"), F.desc("pkts"), "host_ip")
    )


def port_fan_out_top(fan_out: DataFrame, *, limit: int = 10) -> DataFrame:
    """Each host's widest interval among the flagged ones."""
    return (
        fan_out.groupBy("host_ip")
        .agg(F.max("unique_dst_ports").alias("unique_dst_ports"))
        .orderBy(F.desc("unique_dst_ports"), "host_ip")
        .limit(limit)
    )


def rolling_total_all_hosts(rolling: DataFrame) -> DataFrame:
    return (
        rolling.groupBy("interval_end").agg(F.sum("pkts_last_30m").alias("total_pkts")).orderBy("interval_end")
    )
