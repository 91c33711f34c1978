"""Table schemas. Counters are bigint: 32 bits overflow at scale."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "text": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "time": TimestampNTZType(),
}


def _schema(**columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in columns.items()])


PACKETS = _schema(
    ts="time", src_ip="text", src_port="int", dst_ip="text", dst_port="int", protocol="text", pkt_len="int",
    tcp_flags="text", raw_data="text", full_url="text",
)
ALERTS = _schema(ts="time", alert_type="text", src_ip="text", dst_ip="text", details="text", model_name="text")
HOST_STATS = _schema(
    interval_start="time", interval_end="time", host_ip="text", total_packets="bigint", incoming_packets="bigint",
    outgoing_packets="bigint", unique_src_ips="bigint", unique_dst_ports="bigint", total_packets_size="bigint",
)
LABELLED_URLS = _schema(url="text", type="text")
BASELINE = _schema(
    src_ip="text", packet_rate="double", unique_port_count="double", avg_pkt_size="double", generated_at="time"
)
BLOCKLIST = _schema(ip_address="text")

# Column that dates a row: tables are partitioned by its day.
EVENT_TIME = {"packets": "ts", "alerts": "ts", "host_stats": "interval_start"}
TABLES = {"packets": PACKETS, "alerts": ALERTS, "host_stats": HOST_STATS}


def subset(schema: StructType, *columns: str) -> StructType:
    return StructType([schema[c] for c in columns])


# Accepted CSV header lists, in the order they are tried: full form, then without the optional columns.
CSV_LAYOUTS = [
    ("alerts", ALERTS),
    ("alerts", subset(ALERTS, *ALERTS.names[:-1])),
    ("host_stats", HOST_STATS),
    ("packets", PACKETS),
    ("packets", subset(PACKETS, *PACKETS.names[:-2])),
]
