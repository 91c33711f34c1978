"""Detectors: DataFrame of packets in, DataFrame of alert rows out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.functions.derive import (
    SYN_ONLY,
    alert_type_of,
    behaviour_message,
    syn_flood_message,
    url_message,
)
from netsight.operators import timeline
from netsight.session import cut_lineage

ALERT_COLUMNS = ("ts", "alert_type", "src_ip", "dst_ip", "details", "model_name")

# Name of the SYN detector, labels that mean "nothing found" and "anomaly".
SYN_MODEL = "SynFlood"
BENIGN = "benign"
ANOMALY_LABELS = ("-1", "-1.0", "anomaly", "attack")

Detector = Callable[[DataFrame], DataFrame]


def as_alerts(found: DataFrame) -> DataFrame:
    """Rows with ts, src_ip, dst_ip, details, model_name -> alert rows; the type is the first word."""
    return found.withColumn("alert_type", alert_type_of(F.col("details"))).select(*ALERT_COLUMNS)


def syn_packets(packets: DataFrame, window_seconds: float) -> DataFrame:
    """SYN-only packets with their tumbling window."""
    width = f"{int(window_seconds * 1000)} milliseconds"
    return packets.filter((F.col("tcp_flags") == SYN_ONLY) & F.col("src_ip").isNotNull()).withColumn(
        "w", F.window("ts", width)
    )


def syn_flood_windows(packets: DataFrame, *, window_seconds: float = 1, threshold: int = 5) -> DataFrame:
    """Windows in which one source sent more than `threshold` SYN-only packets."""
    return (
        syn_packets(packets, window_seconds)
        .groupBy("w", "src_ip")
        .agg(F.count(F.lit(1)).alias("syn_count"))
        .filter(F.col("syn_count") > threshold)
        .select(F.col("w")["start"].alias("window_start"), F.col("w")["end"].alias("window_end"), "src_ip", "syn_count")
    )


def syn_flood_alerts(
    packets: DataFrame, *, window_seconds: float = 1, threshold: int = 5, prior: DataFrame | None = None
) -> DataFrame:
    """One alert per SYN-only packet beyond the first `threshold` of its source and window.

    Only flooding windows are ranked. A window is ranked in salted parts first: whatever is beyond
    the threshold in its part is beyond it in the whole, and the few rows left of each part settle
    the rest. Rows that would give equal alerts are counted, not carried.

    `prior` (w, src_ip, syn_count) holds packets already seen in those windows, see the streaming form.
    """
    # As many salts as a shuffle has tasks.
    salts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, order, salt = ["w", "src_ip"], ["ts", "dst_ip"], F.pmod(F.xxhash64("ts", "dst_ip"), F.lit(salts))
    syn = syn_packets(packets, window_seconds).withColumn("_salt", salt)
    # The salt is part of the join key too: a join on the window alone would bring all of a busy
    # window to one task, and the ranking would then stay there. Only salts that have rows are listed, so that
    # many small floods do not make more parts than rows.
    counted = syn.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(*key, "_salt", F.sum("n").over(Window.partitionBy(*key)).alias("n"))
    if prior is None:
        floods = counted.withColumn("seen", F.lit(0).cast("bigint"))
    else:
        floods = counted.join(prior.withColumnRenamed("syn_count", "seen"), key, "left").fillna(0, ["seen"])
    every_salt = floods.filter(F.col("n") + F.col("seen") > threshold).select(*key, "_salt", "seen")
    ranked = (
        syn.select(*key, *order, "_salt")
        .join(every_salt, [*key, "_salt"])
        .groupBy(*key, *order, "seen", "_salt")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = F.greatest(F.lit(threshold) - F.col("seen"), F.lit(0))
    in_part = Window.partitionBy(*key, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = ranked.withColumn("_upto", F.sum("n").over(in_part))
    beyond = parts.filter(F.col("_upto") - F.col("n") >= left).withColumn("hits", F.col("n"))
    overall = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    settled = (
        parts.filter(F.col("_upto") - F.col("n") < left)
        .withColumn("_upto", F.sum("n").over(overall))
        .withColumn("hits", F.least(F.col("n"), F.col("_upto") - left))
        .filter(F.col("hits") > 0)
    )
    rows = beyond.unionByName(settled).select("ts", "src_ip", "dst_ip", "hits")
    return as_alerts(
        timeline.repeat_rows(rows, "hits").select(
            "ts", "src_ip", "dst_ip", syn_flood_message(F.col("src_ip")).alias("details"), F.lit(SYN_MODEL).alias("model_name")
        )
    )


@dataclass(frozen=True)
class PacketDetector:
    """Looks at packets one by one: `judge` adds a column, of which `found` and `details` make an alert or none."""

    judge: Detector
    column: str
    found: Callable[[Column], Column]
    details: Callable[[Column], Column]
    model_name: str

    def __call__(self, packets: DataFrame) -> DataFrame:
        return run_detectors(packets, [self])


@dataclass(frozen=True)
class WindowDetector:
    """Needs several packets together: `find` gets the `columns` of the packets that are `wanted`, a condition in SQL."""

    wanted: str
    columns: tuple[str, ...]
    find: Detector

    def __call__(self, packets: DataFrame) -> DataFrame:
        return self.find(packets.filter(self.wanted).select(*self.columns))


def url_detector(classify: Detector, model_name: str) -> PacketDetector:
    """`classify` adds `prediction_label` from `url`, which is empty for a packet without one."""
    return PacketDetector(
        lambda packets: classify(packets.withColumn("url", F.coalesce("full_url", F.lit("")))), "prediction_label",
        lambda label: (F.col("full_url") != "") & (F.lower(label) != BENIGN),
        lambda label: url_message(label, F.col("full_url")), model_name,
    )


def behaviour_detector(score: Detector, model_name: str) -> PacketDetector:
    """`score` adds `prediction`: -1, 'anomaly' or 'attack' flag a row."""
    return PacketDetector(
        score, "prediction", lambda label: F.lower(label.cast("string")).isin(*ANOMALY_LABELS),
        lambda _: behaviour_message(F.lit(model_name)), model_name,
    )


def flood_detector(*, window_seconds: float = 1, threshold: int = 5) -> WindowDetector:
    wanted = f"tcp_flags = '{SYN_ONLY}' AND src_ip IS NOT NULL"
    find = lambda rows: syn_flood_alerts(rows, window_seconds=window_seconds, threshold=threshold)
    return WindowDetector(wanted, ("ts", "src_ip", "dst_ip", "tcp_flags"), find)


def url_alerts(packets: DataFrame, classify: Detector, model_name: str) -> DataFrame:
    """Packets whose URL gets a label other than benign. `classify` adds `prediction_label` from `url`."""
    return run_detectors(packets.filter(F.col("full_url") != ""), [url_detector(classify, model_name)])


def behaviour_alerts(rows: DataFrame, score: Detector, model_name: str) -> DataFrame:
    """Rows that an anomaly model flags. `score` adds `prediction`: -1, 'anomaly' or 'attack' flag a row."""
    return run_detectors(rows, [behaviour_detector(score, model_name)])


def run_detectors(packets: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """Alerts of all detectors together, from one pass over the packets.

    What the detectors of single packets find makes up to one alert each of a packet, as an array. If some need
    several packets together, the pass is stored: the packets with an alert and those wanted, in the few
    columns that are needed. Other functions of packets are called with all packets.

    The outer forms keep rows without an alert until a filter on what they made. A filter on the array itself, also
    the one that Spark adds below a plain explode, is pushed under the detectors, which then judge each packet twice.
    """
    looks = [d for d in detectors if isinstance(d, PacketDetector)]
    windows = [d for d in detectors if isinstance(d, WindowDetector)]
    made = [d(packets).select(*ALERT_COLUMNS) for d in detectors if not isinstance(d, PacketDetector | WindowDetector)]
    rows, alerts = packets, []
    for k, d in enumerate(looks):
        added = d.judge(rows)
        label = f"_judged_{k}"
        rows = added.select(*rows.columns, F.col(d.column).alias(label))
        given = F.struct("ts", "src_ip", "dst_ip", d.details(F.col(label)).alias("details"), F.lit(d.model_name).alias("model_name"))
        alerts.append(F.when(d.found(F.col(label)), given))
    if looks:
        rows = rows.withColumn("_alerts", F.filter(F.array(*alerts), lambda a: a.isNotNull()))
    if windows:
        named = {f"_wanted_{k}": F.coalesce(F.expr(d.wanted), F.lit(False)) for k, d in enumerate(windows)}
        kept = list(dict.fromkeys(c for d in windows for c in d.columns))
        rows = rows.withColumns(named)
        some = reduce(Column.__or__, [F.col(n) for n in named], F.size("_alerts") > 0 if looks else F.lit(False))
        fields = [*kept, *named, *(["_alerts"] if looks else [])]
        rows = rows.select(F.inline_outer(F.when(some, F.array(F.struct(*fields))))).filter(F.col("_wanted_0").isNotNull())
        rows = cut_lineage(rows)
        made += [d.find(rows.filter(n).select(*d.columns)).select(*ALERT_COLUMNS) for n, d in zip(named, windows, strict=True)]
    if looks:
        made.append(as_alerts(rows.select(F.explode_outer("_alerts").alias("a")).filter("a IS NOT NULL").select("a.*")))
    return reduce(DataFrame.unionByName, made)


def on_blocklist(packets: DataFrame, blocklist: DataFrame, *, column: str = "src_ip", listed: bool = True) -> DataFrame:
    """Packets whose address is (or, with listed=False, is not) on the blocklist.

    No broadcast hint: the list may grow, so the optimizer decides from its measured size and AQE
    splits a busy address otherwise.
    """
    matches = F.col(column) == F.col("ip_address")
    return packets.join(blocklist.select("ip_address"), matches, "left_semi" if listed else "left_anti")
