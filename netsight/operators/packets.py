"""Questions asked of the packets table, all over a look-back that ends at `as_of`."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.functions.timefn import since, trunc

AsOf = dt.datetime | str | None


def _recent(packets: DataFrame, as_of: AsOf, hours: float) -> DataFrame:
    return since(packets, "ts", as_of, dt.timedelta(hours=hours))


def _counts(
    packets: DataFrame, keys: Sequence[str], name: str, as_of: AsOf, hours: float, limit: int | None = None
) -> DataFrame:
    """Packets per key, most first; NULL is a key like any other."""
    counts = _recent(packets, as_of, hours).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    ranked = counts.orderBy(F.desc(name), *keys)
    return ranked if limit is None else ranked.limit(limit)


def packets_total(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24) -> DataFrame:
    return _recent(packets, as_of, hours).agg(F.count(F.lit(1)).alias("total_packets_last_24hrs"))


def packets_by_protocol(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24) -> DataFrame:
    return _counts(packets, ["protocol"], "protocol_count", as_of, hours)


def avg_length_by_source(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24) -> DataFrame:
    return (
        _recent(packets, as_of, hours)
        .groupBy("src_ip")
        .agg(F.avg("pkt_len").alias("avg_packet_length"))
        .orderBy(F.desc_nulls_first("avg_packet_length"), "src_ip")
    )


def top_sources(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24, limit: int = 10) -> DataFrame:
    return _counts(packets, ["src_ip"], "frequency", as_of, hours, limit)


def top_destinations(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24, limit: int = 10) -> DataFrame:
    return _counts(packets, ["dst_ip"], "frequency", as_of, hours, limit)


def top_ports(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24, limit: int = 10) -> DataFrame:
    return _counts(packets, ["dst_port"], "activity_count", as_of, hours, limit)


def tcp_flag_usage(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24) -> DataFrame:
    return _counts(packets, ["tcp_flags"], "flag_usage", as_of, hours)


def packets_per_hour(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24) -> DataFrame:
    return (
        _recent(packets, as_of, hours)
        .groupBy(trunc("hour", "ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("packets_per_hour"))
        .orderBy("hour")
    )


def top_pairs(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24, limit: int = 10) -> DataFrame:
    return _counts(packets, ["src_ip", "dst_ip"], "pair_count", as_of, hours, limit)


def longest_packets(packets: DataFrame, *, as_of: AsOf = None, hours: float = 24, limit: int = 10) -> DataFrame:
    rest = [c for c in packets.columns if c != "pkt_len"]
    return _recent(packets, as_of, hours).orderBy(F.desc_nulls_first("pkt_len"), *rest).limit(limit)
