"""The live pipeline: dissected packets -> packets, host statistics, detections, notifications.

Each function takes a streaming DataFrame and starts one query with its own checkpoint. Aggregations
run in Spark's state store; logic that needs the order inside a batch or exact distinct counts runs
per micro-batch with the batch operators and a small carried table, so a busy key is split there as
it is in batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsight.functions.derive import dissect, valid_ip_rows
from netsight.ml import registry, urls
from netsight.operators import detect, rollup, throttle
from netsight.session import cut_lineage
from netsight.sources.tables import DAY, conform
from netsight.streaming import core

DASHBOARD_REFRESH = "10 seconds"
COMPACT_EVERY = 50
ALERT_REFRESH = "15 seconds"


def ingest(raw: DataFrame, path: str, checkpoint: str, **run) -> StreamingQuery:
    """Dissected packet fields -> valid rows of the packets table, one folder per day."""
    rows = conform(valid_ip_rows(dissect(raw)), "packets").withColumn(DAY, F.to_date("ts"))
    return core.start(rows, path, checkpoint, partition_by=DAY, **run)


def host_stats(packets: DataFrame, path: str, checkpoint: str, *, seconds: int = 60, **run) -> StreamingQuery:
    """Statistics per (interval, host), written once an interval is closed by the watermark.

    The state holds flows, spread over hosts, peers and ports. A closed interval leaves the state
    whole in one batch, so the batch's distinct counts are exact and no set sits in the state.
    """
    flows = rollup.flows(core.event_time(packets), seconds=seconds)

    def write(batch: DataFrame, batch_id: int) -> None:
        core.write_batch(rollup.host_stats_of_flows(cut_lineage(core.to_ntz(batch))), path, batch_id)

    return core.start_batches(flows, write, checkpoint, **run)


def syn_flood_windows(packets: DataFrame, path: str, checkpoint: str, *, window_seconds: float = 1,
                      threshold: int = 5, **run) -> StreamingQuery:
    """Flooding (window, source) pairs, written once the window is closed."""
    floods = detect.syn_flood_windows(core.event_time(packets), window_seconds=window_seconds, threshold=threshold)
    return core.start(core.to_ntz(floods), path, checkpoint, **run)


def syn_flood_alerts(packets: DataFrame, path: str, state: str, checkpoint: str, *, window_seconds: float = 1,
                     threshold: int = 5, delay_seconds: float = 10, **run) -> StreamingQuery:
    """One alert per SYN packet beyond the threshold of its window, as soon as the packet arrives.

    Counts of windows that are still open are carried between batches; packets of windows that
    ended more than the delay before the newest one are late and dropped.
    """
    wanted = packets.filter(F.col("tcp_flags") == detect.SYN_ONLY).select("ts", "src_ip", "dst_ip", "tcp_flags")
    flood = _Floods(core.Carried(state), window_seconds, threshold, delay_seconds)

    def write(batch: DataFrame, batch_id: int) -> None:
        core.write_batch(flood.alerts(cut_lineage(batch), batch_id), path, batch_id)

    return core.start_batches(wanted, write, checkpoint, **run)


@dataclass
class _Floods:
    """SYN-flood alerts batch by batch, with the counts of the windows that are still open."""

    carried: core.Carried
    window_seconds: float
    threshold: int
    delay_seconds: float

    def alerts(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """`batch` is read several times, so it should be stored."""
        prior, delay = self.carried.before(batch.sparkSession, batch_id), F.expr(f"interval {self.delay_seconds} seconds")
        if prior is not None:
            newest = prior.agg(F.max(F.col("w")["end"])).first()[0]
            if newest is not None:
                batch = detect.syn_packets(batch, self.window_seconds).filter(F.col("w")["end"] > F.lit(newest) - delay).drop("w")
        found = detect.syn_flood_alerts(batch, window_seconds=self.window_seconds, threshold=self.threshold, prior=prior)
        counts = detect.syn_packets(batch, self.window_seconds).groupBy("w", "src_ip").agg(F.count(F.lit(1)).alias("syn_count"))
        if prior is not None:
            counts = counts.unionByName(prior).groupBy("w", "src_ip").agg(F.sum("syn_count").alias("syn_count"))
        newest = counts.agg(F.max(F.col("w")["end"])).first()[0]
        if newest is not None:
            counts = counts.filter(F.col("w")["end"] > F.lit(newest) - delay)
        self.carried.store(counts, batch_id)
        return found


def scored_urls(packets: DataFrame, model, path: str, checkpoint: str, **run) -> StreamingQuery:
    """Every packet with a URL and its predicted class."""
    rows = packets.filter(F.col("full_url") != "").withColumn("url", F.col("full_url"))
    return core.start(urls.score(model, rows), path, checkpoint, **run)


def _throttled(rows: DataFrame, carried: core.Carried, batch_id: int, keys: Sequence[str], seconds: float,
               delay_seconds: float) -> DataFrame:
    """What passes of this batch; stores the last time each key passed.

    Of a key that passed longer ago than the throttle, and the delay that late rows may have, nothing
    needs to be known: the state holds what passed since then.
    """
    spark = rows.sparkSession
    sent = carried.before(spark, batch_id)
    passing = cut_lineage(throttle.throttle(rows, seconds=seconds, keys=keys, last_sent=sent))
    last = passing.select(*keys, F.col("ts").alias("last_ts"))
    if sent is not None:
        last = last.unionByName(sent)
    last = last.groupBy(*keys).agg(F.max("last_ts").alias("last_ts")) if keys else last.agg(F.max("last_ts").alias("last_ts"))
    newest = last.agg(F.max("last_ts")).first()[0]
    if newest is not None:
        last = last.filter(F.col("last_ts") >= F.lit(newest) - F.expr(f"interval {seconds + delay_seconds} seconds"))
    carried.store(last, batch_id)
    return passing


def notifications(alerts: DataFrame, path: str, state: str, checkpoint: str, *, seconds: float = 300,
                  keys: Sequence[str] = throttle.SINGLE_KEY, delay_seconds: float = 10, **run) -> StreamingQuery:
    """Alerts that may be sent: per key none within `seconds` of the last one that was."""
    carried = core.Carried(state)

    def write(batch: DataFrame, batch_id: int) -> None:
        core.write_batch(_throttled(cut_lineage(batch), carried, batch_id, keys, seconds, delay_seconds), path, batch_id)

    return core.start_batches(alerts, write, checkpoint, **run)


@dataclass
class _Chosen:
    """The model the analyst has chosen, looked up once per micro-batch, loaded when name or version changed."""

    root: str
    held: tuple[tuple[str, str | None], object] | None = None

    def now(self, spark: SparkSession) -> tuple[str, object]:
        name = registry.current(spark, self.root)
        key = (name, registry.newest_version(spark, self.root, name))
        if self.held is None or self.held[0] != key:
            self.held = key, registry.load(spark, self.root, name)
        return name, self.held[1]


def url_alerts(packets: DataFrame, models: str, alerts_path: str, sent_path: str, state: str, checkpoint: str, *,
               seconds: float = 300, keys: Sequence[str] = throttle.SINGLE_KEY, delay_seconds: float = 10,
               **run) -> StreamingQuery:
    """Alerts of the currently chosen URL model, stored and, throttled, passed on for sending."""
    carried, chosen = core.Carried(state), _Chosen(models)

    def write(batch: DataFrame, batch_id: int) -> None:
        name, model = chosen.now(batch.sparkSession)
        found = cut_lineage(detect.url_alerts(batch, lambda d: urls.score(model, d), name))
        core.write_batch(found, alerts_path, batch_id)
        core.write_batch(_throttled(found, carried, batch_id, keys, seconds, delay_seconds), sent_path, batch_id)

    return core.start_batches(packets, write, checkpoint, **run)


def behaviour_alerts(packets: DataFrame, model: object | str, path: str, checkpoint: str, *, seconds: int = 60,
                     **run) -> StreamingQuery:
    """Alerts for (interval, source) whose traffic a behaviour model flags, once the interval is closed.

    `model`: a fitted model, or the root of the registry, whose chosen model is then used. The features
    are those of `rollup.traffic_features`, from the flows of the closed interval.
    """
    flows = rollup.flows(core.event_time(packets), seconds=seconds)
    chosen = _Chosen(model) if isinstance(model, str) else None

    def write(batch: DataFrame, batch_id: int) -> None:
        name, fitted = chosen.now(batch.sparkSession) if chosen else (type(model).__name__, model)
        features = rollup.features_of_flows(cut_lineage(core.to_ntz(batch)), seconds=seconds)
        rows = features.withColumnRenamed("interval_start", "ts").withColumn("dst_ip", F.lit(None).cast("string"))
        core.write_batch(detect.behaviour_alerts(rows, fitted.score, name), path, batch_id)

    return core.start_batches(flows, write, checkpoint, **run)


def detector_engine(packets: DataFrame, detectors: Sequence[detect.Detector], alerts_path: str, sent_path: str, state: str,
                    checkpoint: str, *, window_seconds: float = 1, threshold: int = 5, seconds: float = 300,
                    keys: Sequence[str] = throttle.SINGLE_KEY, delay_seconds: float = 10, **run) -> StreamingQuery:
    """All detectors over one packet stream: SYN floods, counted on over batches, and detectors that look
    at packets one by one (`detect.url_alerts`, `detect.behaviour_alerts`). One table of alerts, and those
    that pass the throttle."""
    flood = _Floods(core.Carried(f"{state}/floods"), window_seconds, threshold, delay_seconds)
    sent = core.Carried(f"{state}/sent")

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = cut_lineage(batch)
        floods = flood.alerts(stored, batch_id)
        found = cut_lineage(detect.run_detectors(stored, [lambda _: floods, *detectors]))
        core.write_batch(found, alerts_path, batch_id)
        core.write_batch(_throttled(found, sent, batch_id, keys, seconds, delay_seconds), sent_path, batch_id)

    return core.start_batches(packets, write, checkpoint, **run)


def scan_bursts(alerts: DataFrame, path: str, checkpoint: str, *, alert_type: str = "Port Scan",
                gap_seconds: int = 30, min_scans: int = 3, **run) -> StreamingQuery:
    """Bursts of one source, written once the pause after them is over."""
    bursts = (
        core.event_time(alerts.filter(F.col("alert_type") == alert_type))
        .groupBy("src_ip", F.session_window("ts", f"{gap_seconds} seconds"))
        .agg(F.min("ts").alias("burst_start"), F.max("ts").alias("burst_end"), F.count(F.lit(1)).alias("scans_in_burst"))
        .filter(F.col("scans_in_burst") >= min_scans)
        .select("src_ip", "burst_start", "burst_end", "scans_in_burst")
    )
    return core.start(core.to_ntz(bursts), path, checkpoint, **run)


def _changed_rows(counts: DataFrame, keys: Sequence[str], path: str, checkpoint: str, every: str, run: dict) -> StreamingQuery:
    """Rows that changed in each refresh; `core.newest_rows` gives the current table. Every COMPACT_EVERY
    refreshes the table is folded to its current rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        core.write_batch(core.to_ntz(batch), path, batch_id)
        if batch_id and batch_id % COMPACT_EVERY == 0:
            core.compact(batch.sparkSession, path, keys, batch_id)

    return core.start_batches(counts, write, checkpoint, mode="update", every=every, **run)


def dashboard_hours(alerts: DataFrame, path: str, checkpoint: str, *, delay: str = "1 hour", **run) -> StreamingQuery:
    """Running alert counts per (hour, type)."""
    counts = (
        core.event_time(alerts, delay=delay)
        .groupBy(F.window("ts", "1 hour").alias("w"), "alert_type")
        .agg(F.count(F.lit(1)).alias("alert_cnt"))
        .select(F.col("w")["start"].alias("hour_bucket"), "alert_type", "alert_cnt")
    )
    return _changed_rows(counts, ["hour_bucket", "alert_type"], path, checkpoint, DASHBOARD_REFRESH, run)


def dashboard_minutes(alerts: DataFrame, path: str, checkpoint: str, *, delay: str = "1 hour", **run) -> StreamingQuery:
    """Running alert counts per minute."""
    counts = (
        core.event_time(alerts, delay=delay)
        .groupBy(F.window("ts", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("alerts_in_min"))
        .select(F.col("w")["start"].alias("minute_bucket"), "alerts_in_min")
    )
    return _changed_rows(counts, ["minute_bucket"], path, checkpoint, ALERT_REFRESH, run)


def dashboard_sources(alerts: DataFrame, path: str, checkpoint: str, *, horizon: str = "365 days", delay: str = "1 hour",
                      **run) -> StreamingQuery:
    """Running totals per source and horizon; the top of `core.newest_rows(...)` is the current ranking.

    Totals start anew with each horizon, an aligned span of event time, so that the state of past ones
    can go.
    """
    counts = core.event_time(alerts, delay=delay).groupBy(F.window("ts", horizon).alias("w"), "src_ip").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("alert_type") == "Port Scan").alias("port_scans"),
        F.count_if(F.col("alert_type") == "DDoS").alias("ddos_hits"),
    ).select(F.col("w")["start"].alias("since"), "src_ip", "total_alerts", "port_scans", "ddos_hits")
    return _changed_rows(counts, ["since", "src_ip"], path, checkpoint, DASHBOARD_REFRESH, run)
