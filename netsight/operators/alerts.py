"""Questions asked of the alerts table.

Every look-back ends at `as_of` (default: the newest alert); thresholds are keyword parameters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.functions.derive import packet_count_of
from netsight.functions.timefn import ntz_literal, resolve_as_of, since, trunc
from netsight.operators import timeline

AsOf = dt.datetime | str | None

# Alert types the summaries single out, and the horizons in hours under their column
# names (the middle one looks back 1000 hours in spite of its name).
PORT_SCAN, DDOS = "Port Scan", "DDoS"
HORIZONS = {"last_1h": 1, "last_12h": 1000, "last_24h": 24}

RECENT_COLUMNS = ("alert_id", "ts", "alert_type", "src_ip", "dst_ip", "details", "model_name")


def _n(condition=None):
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def alerts_by_hour(alerts: DataFrame, *, as_of: AsOf = None, hours: float = 24, newest_first: bool = False) -> DataFrame:
    counts = (
        since(alerts, "ts", as_of, dt.timedelta(hours=hours))
        .groupBy(trunc("hour", "ts").alias("hour_bucket"), "alert_type")
        .agg(_n().alias("alert_cnt"))
    )
    if newest_first:
        return counts.orderBy(F.desc("hour_bucket"), F.desc("alert_cnt"), "alert_type")
    return counts.orderBy("hour_bucket", "alert_type")


def alert_counts_by_horizon(
    alerts: DataFrame, *, as_of: AsOf = None, horizons: Mapping[str, float] = HORIZONS
) -> DataFrame:
    """Alerts per (type, source) within each look-back, in one pass over the longest of them."""
    end = resolve_as_of(alerts, "ts", as_of)
    back = {name: ntz_literal(end - dt.timedelta(hours=h)) for name, h in horizons.items()}
    longest = dt.timedelta(hours=max(horizons.values()))
    return (
        since(alerts, "ts", end, longest)
        .groupBy("alert_type", "src_ip")
        .agg(*[_n(F.col("ts") >= start).alias(name) for name, start in back.items()])
        .orderBy("alert_type", "src_ip")
    )


def top_sources(alerts: DataFrame, *, limit: int = 5) -> DataFrame:
    return (
        alerts.groupBy("src_ip")
        .agg(
            _n().alias("total_alerts"),
            _n(F.col("alert_type") == PORT_SCAN).alias("port_scans"),
            _n(F.col("alert_type") == DDOS).alias("ddos_hits"),
        )
        .orderBy(F.desc("total_alerts"), "src_ip")
        .limit(limit)
    )


def most_attacked(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("dst_ip", "alert_type")
        .agg(_n().alias("hits"))
        .orderBy(F.desc("hits"), "dst_ip", "alert_type")
    )


def avg_alert_gap(alerts: DataFrame, *, all_label: str = "ALL TYPES") -> DataFrame:
    """Mean seconds between consecutive alerts, per type and over all types, from one pass."""
    per_type = alerts.groupBy("alert_type").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("ts").alias("n")
    )
    labels = F.array(F.struct(F.lit(0).alias("all"), F.col("alert_type").alias("t")),
                     F.struct(F.lit(1).alias("all"), F.lit(all_label).alias("t")))
    pauses = F.sum("n") - 1
    span = F.timestamp_diff("MICROSECOND", F.min("lo"), F.max("hi"))
    return (
        per_type.withColumn("as", F.explode(labels))
        .groupBy("as")
        .agg(F.round(span / F.when(pauses > 0, pauses) / 1e6, 1).alias("avg_gap_seconds"))
        .filter(F.col("avg_gap_seconds").isNotNull())
        .orderBy("as")
        .select(F.col("as")["t"].alias("alert_type"), "avg_gap_seconds")
    )


def rolling_type_count(
    alerts: DataFrame, *, alert_type: str = DDOS, minutes: int = 10, name: str = "ddos_window", ordered: bool = True
) -> DataFrame:
    """For every alert, how many alerts of one type fell in the minutes up to and including it."""
    hits = F.when(F.col("alert_type") == alert_type, 1)
    totals = timeline.rolling_total(alerts, "ts", minutes * 60, hits)
    counts = totals.select("ts", F.coalesce("total", F.lit(0).cast("bigint")).alias(name), timeline.COPIES)
    rows = timeline.repeat_rows(counts, timeline.COPIES, number="_n")
    # The number lets a sort spread alerts of one busy moment.
    return (rows.orderBy("ts", "_n") if ordered else rows).drop("_n")


def alerts_per_minute(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy(trunc("minute", "ts").alias("minute_bucket"))
        .agg(_n().alias("alerts_in_min"))
        .orderBy("minute_bucket")
    )


def heaviest_floods(alerts: DataFrame, *, alert_type: str = DDOS, limit: int = 10) -> DataFrame:
    return (
        alerts.filter(F.col("alert_type") == alert_type)
        .select("alert_id", "src_ip", "dst_ip", packet_count_of(F.col("details")).alias("packet_count"), "ts")
        .orderBy(F.desc_nulls_last("packet_count"), "alert_id")
        .limit(limit)
    )


def scan_bursts(
    alerts: DataFrame, *, alert_type: str = PORT_SCAN, gap_seconds: float = 30, min_scans: int = 3
) -> DataFrame:
    scans = alerts.filter(F.col("alert_type") == alert_type)
    return (
        timeline.bursts(scans, "ts", "src_ip", gap_seconds, min_scans)
        .withColumnRenamed("n", "scans_in_burst")
        .orderBy(F.desc("scans_in_burst"), "src_ip", "burst_start")
    )


def quiet_periods(alerts: DataFrame, *, min_minutes: float = 10) -> DataFrame:
    return timeline.silences(alerts, "ts", min_minutes * 60).orderBy(F.desc("silence_seconds"), "gap_start")


def top_attack_pairs(alerts: DataFrame, *, limit: int = 8) -> DataFrame:
    """Busiest (source, target) pairs with the alert types seen, sorted.

    Counting per type first keeps the wide pass a plain hash aggregate; the sets then hold one
    entry per type.
    """
    return (
        alerts.groupBy("src_ip", "dst_ip", "alert_type")
        .agg(_n().alias("n"))
        .groupBy("src_ip", "dst_ip")
        .agg(F.sum("n").alias("pair_alerts"), F.sort_array(F.collect_set("alert_type")).alias("types_seen"))
        .orderBy(F.desc("pair_alerts"), "src_ip", "dst_ip")
        .limit(limit)
    )


def recent_alerts(alerts: DataFrame, *, limit: int = 10) -> DataFrame:
    return alerts.select(*RECENT_COLUMNS).orderBy(F.desc_nulls_first("ts"), F.desc("alert_id")).limit(limit)


# Shapes of the hourly counts that the dashboard draws.


def hourly_type_map(hourly: DataFrame) -> DataFrame:
    """One row per hour with a map of alert type -> count."""
    entries = F.sort_array(F.collect_list(F.struct("alert_type", "alert_cnt")))
    return (
        hourly.filter(F.col("alert_type").isNotNull())
        .groupBy("hour_bucket")
        .agg(F.map_from_entries(entries).alias("counts"))
        .orderBy("hour_bucket")
    )


def hourly_type_series(hourly: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row per hour, one column per named type, 0 where an hour has none."""
    return (
        hourly.groupBy("hour_bucket")
        .agg(*[
            F.coalesce(F.sum(F.when(F.col("alert_type") == t, F.col("alert_cnt"))), F.lit(0).cast("bigint")).alias(t)
            for t in types
        ])
        .orderBy("hour_bucket")
    )


def type_totals(hourly: DataFrame, types: Sequence[str]) -> DataFrame:
    return hourly.agg(*[
        F.coalesce(F.sum(F.when(F.col("alert_type") == t, F.col("alert_cnt"))), F.lit(0).cast("bigint")).alias(t)
        for t in types
    ])
