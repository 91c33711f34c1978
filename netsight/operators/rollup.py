"""Packets -> per-host traffic statistics and per-source features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW = ("interval_start", "interval_end", "src_ip", "dst_ip", "dst_port")


def _in_window(seconds: int, ts: str = "ts") -> Column:
    return F.window(ts, f"{seconds} seconds")


def flows(packets: DataFrame, *, seconds: int = 60) -> DataFrame:
    """Packets and bytes per (interval, source, target, target port).

    The one pass over raw packets. It combines before the shuffle, and a busy host is spread over
    its peers and ports; all that follows works on flows. Port 0 counts as no port.
    """
    ends = (F.col("src_ip") != "") & (F.col("dst_ip") != "")
    return (
        packets.filter(ends)
        .groupBy(
            _in_window(seconds).alias("w"),
            "src_ip",
            "dst_ip",
            F.nullif(F.col("dst_port"), F.lit(0)).alias("dst_port"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("pkt_len", F.lit(0))).alias("bytes"))
        .select(F.col("w")["start"].alias("interval_start"), F.col("w")["end"].alias("interval_end"), *FLOW[2:], "n", "bytes")
    )


def both_hosts() -> Column:
    """Both hosts of a row: its source as sender, its target as receiver. Traffic of a host with itself counts twice."""
    return F.array(
        F.struct(F.col("src_ip").alias("host_ip"), F.lit(0).alias("inc"), F.lit(1).alias("out")),
        F.struct(F.col("dst_ip").alias("host_ip"), F.lit(1).alias("inc"), F.lit(0).alias("out")),
    )


def host_totals(packets: DataFrame, *, seconds: int = 60) -> DataFrame:
    """The sums of host_stats without its distinct counts: one shuffle of one row per task, interval and host."""
    size = F.coalesce("pkt_len", F.lit(0)).cast("bigint")
    return (
        packets.filter((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
        .select(_in_window(seconds).alias("w"), size.alias("bytes"), F.explode(both_hosts()).alias("h"))
        .groupBy("w", F.col("h")["host_ip"].alias("host_ip"))
        .agg(
            F.count(F.lit(1)).alias("total_packets"), F.sum("h.inc").alias("incoming_packets"),
            F.sum("h.out").alias("outgoing_packets"), F.sum("bytes").alias("total_packets_size"),
        )
        .select(F.col("w")["start"].alias("interval_start"), F.col("w")["end"].alias("interval_end"), "host_ip",
                "total_packets", "incoming_packets", "outgoing_packets", "total_packets_size")
    )


def host_stats_of_flows(flow_rows: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Each flow counts for its source as outgoing and for its target as incoming traffic.

    Both hosts note the flow's source address and target port, so a sender is one of its own
    sources, and traffic of a host with itself counts on both sides. `approximate` trades the exact
    distinct counts, and the shuffle they need, for sketches.
    """
    where = ["interval_start", "interval_end", "host_ip"]
    sides = flow_rows.withColumn("h", F.explode(both_hosts())).select(
        *where[:2], "h.*", "src_ip", "dst_port", "n", "bytes", (F.col("n") * F.col("h.inc")).alias("n_in")
    )
    if approximate:
        return sides.groupBy(*where).agg(
            F.sum("n").alias("total_packets"), F.sum("n_in").alias("incoming_packets"),
            F.sum(F.col("n") - F.col("n_in")).alias("outgoing_packets"),
            F.approx_count_distinct("src_ip").alias("unique_src_ips"),
            F.approx_count_distinct("dst_port").alias("unique_dst_ports"),
            F.sum("bytes").alias("total_packets_size"),
        )
    # What a host notes, sources and ports alike, is summed first: then a distinct value is a row. The sums
    # go with the sources; a port brings nothing but itself.
    none = F.lit(0).cast("bigint")
    noted = F.array(
        F.struct(F.lit(True).alias("source"), F.col("src_ip").alias("value"), F.col("n"), F.col("n_in"), F.col("bytes")),
        F.struct(F.lit(False).alias("source"), F.col("dst_port").cast("string").alias("value"), none.alias("n"), none.alias("n_in"), none.alias("bytes")),
    )
    values = sides.select(*where, F.explode(noted).alias("v")).groupBy(*where, "v.source", "v.value").agg(
        *[F.sum(F.col("v")[c]).alias(c) for c in ("n", "n_in", "bytes")]
    )
    return values.groupBy(*where).agg(
        F.sum("n").alias("total_packets"), F.sum("n_in").alias("incoming_packets"),
        F.sum(F.col("n") - F.col("n_in")).alias("outgoing_packets"), F.count_if("source").alias("unique_src_ips"),
        F.count(F.when(~F.col("source"), F.col("value"))).alias("unique_dst_ports"), F.sum("bytes").alias("total_packets_size"),
    )


def host_stats(packets: DataFrame, *, seconds: int = 60, approximate: bool = False) -> DataFrame:
    """Statistics per (interval, host)."""
    return host_stats_of_flows(flows(packets, seconds=seconds), approximate=approximate)


def features_of_flows(flow_rows: DataFrame, *, seconds: int = 60) -> DataFrame:
    return flow_rows.groupBy("interval_start", "src_ip").agg(
        (F.sum("n") / F.lit(float(seconds))).alias("packet_rate"),
        F.count_distinct("dst_port").cast("double").alias("unique_port_count"),
        (F.sum("bytes") / F.sum("n")).alias("avg_pkt_size"),
    )


def traffic_features(packets: DataFrame, *, seconds: int = 60) -> DataFrame:
    """What the anomaly models look at, per (interval, source): packet rate, distinct target ports,
    mean packet size."""
    return features_of_flows(flows(packets, seconds=seconds), seconds=seconds)
