"""Every operator as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from netsight.functions import derive
from netsight.ml import anomaly, evaluate, registry, split, training, urls
from netsight.operators import alerts as A
from netsight.operators import detect as S
from netsight.operators import hosts as H
from netsight.operators import packets as P
from netsight.operators import rollup, sketches, throttle
from netsight.plans import driver_tables as T
from netsight.session import cut_lineage, scratch_path, ship_package
from netsight.sources import csv, exports, tables
from netsight.sources.schemas import ALERTS, TABLES
from netsight.sources.tables import DAY
from netsight.streaming import core, keyed, live, ordered

Query = Callable[[SparkSession, str], DataFrame]


def on(source: Callable[..., DataFrame], op: Callable[..., DataFrame], **kw) -> Query:
    """The operator over one derived table."""
    return lambda spark, sf_dir: op(source(spark, sf_dir), **kw)


def on_stats(op: Callable[..., DataFrame], **kw) -> Query:
    """The operator over host_stats as of its newest interval."""
    return lambda spark, sf_dir: op(T.host_stats(spark, sf_dir), as_of=T.stats_as_of(spark, sf_dir), **kw)


def on_totals(op: Callable[..., DataFrame], **kw) -> Query:
    """The operator over the sums of host_stats as of its newest interval."""
    return lambda spark, sf_dir: op(T.host_totals(spark, sf_dir), as_of=T.stats_as_of(spark, sf_dir), **kw)


def _pairs(alerts: DataFrame) -> DataFrame:
    return A.top_attack_pairs(alerts).withColumn("types_seen", F.array_join("types_seen", ","))


def _beside_exact(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Estimated statistics beside exact distinct counts, and whether the estimates are within three standard errors
    (and the half that rounding may add)."""

    def close(name: str) -> Column:
        return F.abs(F.col(name) - F.col(f"exact_{name}")) <= 3 * sketches.relative_error() * F.col(f"exact_{name}") + 0.5

    names, keys = ("unique_src_ips", "unique_dst_ports"), ["interval_start", "host_ip"]
    both = found.join(exact.select(*keys, *[F.col(n).alias(f"exact_{n}") for n in names]), keys, "left")
    return both.select(*[c for c in found.columns if c not in names], *[f"exact_{n}" for n in names],
                       close(names[0]).alias("sources_close"), close(names[1]).alias("ports_close"))


def _sketched_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of minutes, stored, and united into hours."""
    path = scratch_path(spark, "sketches")
    sketches.store(sketches.host_sketches(T.packets(spark, sf_dir)), path)
    found = sketches.estimated(sketches.united(sketches.stored(spark, path), seconds=3600))
    return _beside_exact(found, T.host_stats(spark, sf_dir, seconds=3600))


def _hour_map(alerts: DataFrame) -> DataFrame:
    text = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return A.hourly_type_map(A.alerts_by_hour(alerts)).withColumn("counts", F.array_join(text, ","))


def _same(df: DataFrame) -> DataFrame:
    return df


SYN_TYPE, DDOS_TYPE = "SYN Flood", "DDoS"


def batch_queries() -> dict[str, Query]:
    al, pk, hs = T.alerts, T.packets, T.host_stats
    types = [SYN_TYPE, DDOS_TYPE]
    return {
        "driver_packets": on(pk, _same),
        "driver_alerts": on(al, _same),
        "alerts_by_hour": on(al, A.alerts_by_hour),
        "alerts_by_hour_36h": on(al, A.alerts_by_hour, hours=36, newest_first=True),
        "alert_counts_multi_horizon": on(al, A.alert_counts_by_horizon),
        "top_sources": on(al, A.top_sources),
        "most_attacked_dst": on(al, A.most_attacked),
        "avg_alert_gap": on(al, A.avg_alert_gap),
        "ddos_rolling_10m": on(al, A.rolling_type_count),
        "alerts_per_minute": on(al, A.alerts_per_minute),
        "heaviest_floods": on(al, A.heaviest_floods),
        "scan_bursts": on(al, A.scan_bursts),
        "scan_bursts_2h": on(al, A.scan_bursts, gap_seconds=7200),
        "quiet_periods": on(al, A.quiet_periods),
        "top_attack_pairs": on(al, _pairs),
        "recent_alerts": on(al, A.recent_alerts),
        "top_bandwidth": on_totals(H.top_bandwidth),
        "top_bandwidth_1000min": on_totals(H.top_bandwidth, minutes=1000),
        "avg_pkt_size": on(T.host_totals, H.avg_packet_size),
        "heavy_outgoing": on_totals(H.heavy_outgoing),
        "heavy_outgoing_2x": on_totals(H.heavy_outgoing, factor=2, null_ratio_as_zero=False),
        "heavy_outgoing_1h_2x": on_totals(H.heavy_outgoing, hours=1, factor=2, null_ratio_as_zero=False),
        "heavy_outgoing_half": on_totals(H.heavy_outgoing, factor=0.5, null_ratio_as_zero=False),
        "heavy_outgoing_1h_half": on_totals(H.heavy_outgoing, hours=1, factor=0.5, null_ratio_as_zero=False),
        "heavy_outgoing_20h": on_totals(H.heavy_outgoing, hours=20),
        "port_fan_out": on_stats(H.port_fan_out),
        "port_fan_out_12h": on_stats(H.port_fan_out, hours=12),
        "new_source_spike": on_stats(H.new_source_spike),
        "new_source_spike_10": on_stats(H.new_source_spike, min_jump=10),
        "rolling_30m_packets": on_totals(H.rolling_packets),
        "hourly_heatmap": on(T.host_totals, H.hourly_heatmap),
        "packets_total": on(pk, P.packets_total),
        "packets_by_protocol": on(pk, P.packets_by_protocol),
        "avg_len_by_src": on(pk, P.avg_length_by_source),
        "top_src": on(pk, P.top_sources),
        "top_dst": on(pk, P.top_destinations),
        "top_dst_ports": on(pk, P.top_ports),
        "tcp_flag_usage": on(pk, P.tcp_flag_usage),
        "packets_per_hour": on(pk, P.packets_per_hour),
        "top_pairs": on(pk, P.top_pairs),
        "longest_packets": on(pk, P.longest_packets),
        "alerts_by_hour_pivot": on(al, _hour_map),
        "port_fanout_top10": on_stats(lambda d, as_of: H.port_fan_out_top(H.port_fan_out(d, as_of=as_of))),
        "rolling_total_all_hosts": on_stats(
            lambda d, as_of: H.rolling_total_all_hosts(H.rolling_packets(d, as_of=as_of, ordered=False))
        ),
        "hourly_type_series": on(al, lambda d: A.hourly_type_series(A.alerts_by_hour(d), types)),
        "type_totals": on(al, lambda d: A.type_totals(A.alerts_by_hour(d), types)),
        "host_stats_rollup": on(pk, rollup.host_stats, seconds=60),
        "host_stats_10min": on(pk, rollup.host_stats, seconds=T.STATS_SECONDS),
        "host_sketch_hours": _sketched_hours,
        "traffic_features": on(pk, rollup.traffic_features, seconds=T.STATS_SECONDS),
        "syn_flood_windows": on(pk, S.syn_flood_windows),
        "syn_flood_windows_60s": on(pk, S.syn_flood_windows, window_seconds=60, threshold=2),
        "syn_flood_alerts": on(pk, S.syn_flood_alerts),
        "syn_flood_alerts_60s": on(pk, S.syn_flood_alerts, window_seconds=60, threshold=2),
        "notify_throttle": on(al, throttle.throttle, keys=("alert_type", "src_ip"), ties=["alert_id"]),
        "notify_throttle_single": on(al, throttle.throttle, ties=["alert_id"]),
        "blocklist_match": lambda s, d: S.on_blocklist(T.packets(s, d), T.blocklist(s, d)),
        "blocklist_miss": lambda s, d: S.on_blocklist(T.packets(s, d), T.blocklist(s, d), listed=False),
    }




# Row-level derivations ------------------------------------------------------------------------------


def _detector_urls(raw: DataFrame) -> DataFrame:
    c = F.col
    fields = (c("has_http"), c("http_host"), c("http_full_uri"), c("http_uri"), c("tls_sni"))
    return raw.select(
        "ts", derive.full_url(*fields).alias("capture_url"), derive.full_url(*fields, any_case=True).alias("detector_url")
    )


def _alert_texts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "alert_id",
        derive.alert_type_of(F.col("details")).alias("first_word"),
        derive.packet_count_of(F.col("details")).alias("packet_count"),
        derive.syn_flood_message(F.col("src_ip")).alias("syn_message"),
        derive.url_message(F.col("alert_type"), F.col("dst_ip")).alias("url_message"),
        derive.behaviour_message(F.col("model_name")).alias("behaviour_message"),
    )


def _ratios(stats: DataFrame) -> DataFrame:
    value = derive.ratio(F.col("outgoing_packets"), F.col("incoming_packets"))
    return stats.select("interval_start", "host_ip", value.alias("out_in_ratio"))


def _clamped(suppliers: DataFrame) -> DataFrame:
    return suppliers.select("s_suppkey", derive.at_least(F.col("s_acctbal"), 0.0).alias("clamped"))


def _coerced(alerts: DataFrame) -> DataFrame:
    text = F.when(F.col("alert_id") % 5 == 0, "n/a").otherwise(F.col("ts").cast("string"))
    return csv.coerce_timestamps(alerts.select("alert_id", text.alias("at")), "at")


def derivation_queries() -> dict[str, Query]:
    raw = T.raw_packets
    return {
        "dissect_packets": on(raw, derive.dissect),
        "full_url_forms": on(raw, _detector_urls),
        "valid_ip_filter": on(raw, lambda d: derive.valid_ip_rows(d).select("ts", "src_ip", "dst_ip")),
        "alert_texts": on(T.alerts, _alert_texts),
        "numeric_clamp": lambda s, d: _clamped(T.table(s, d, "supplier")),
        "ratio_null_safe": on(T.host_stats, _ratios),
        "iso_timestamp_coerce": on(T.alerts, _coerced),
    }


# Sources and sinks: written to the shared folder and read back ---------------------------------------


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of three known layouts and one unknown, in the shared folder. Of the alerts, some are in
    files whose texts go over line ends, with quotes and commas in them. Of the packets, some are in
    a file with bad values in a middle column, some in one where whole numbers have gaps, as a data frame
    writes them, and some in a folder with a space in its name."""
    folder = scratch_path(spark, "csv")
    packets, kind = T.packets(spark, sf_dir), F.col("src_port") % 50
    alerts = T.alerts(spark, sf_dir)
    port, length = F.col("src_port").cast("string"), F.col("pkt_len").cast("string")
    bad = packets.filter(kind == 0).withColumn("pkt_len", F.when(F.col("pkt_len") % 3 == 0, "oops").otherwise(length))
    made = {
        "alerts": alerts.filter(F.col("alert_id") % 4 != 3).select(*ALERTS.names),
        "lines": alerts.filter(F.col("alert_id") % 4 == 3).withColumn("details", _over_lines()).select(*ALERTS.names),
        "packets": packets.filter(kind > 2),
        "bad": bad.repartition(1).sortWithinPartitions(*bad.columns),  # filtered where the rows are
        "gaps": packets.filter(kind == 1).withColumn(
            "src_port", F.when(F.col("pkt_len") % 2 == 0, "NaN").otherwise(F.concat(port, F.lit(".0")))
        ),
        "with space": packets.filter(kind == 2),
        "host_stats": T.host_stats(spark, sf_dir),
        "blocklist": T.blocklist(spark, sf_dir),
    }
    for name, df in made.items():
        exports.write_csv(df, f"{folder}/{name}")
    return folder


def _over_lines() -> Column:
    """Alert details with a quoted word, a line end of either kind, a comma and an empty line."""
    end = F.when(F.col("alert_id") % 8 == 3, "\r\n").otherwise("\n")
    return F.concat(F.lit('"seen": '), "details", end, end, F.lit('then, "'), F.col("alert_id"), F.lit('"'))


def _csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = csv.load_folder(spark, f"{_csv_folder(spark, sf_dir)}/*", scratch_path(spark, "tables"))
    return report.groupBy("table", "status").agg(F.sum("n_rows").alias("n_rows"))


def _csv_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tables")
    csv.load_folder(spark, f"{_csv_folder(spark, sf_dir)}/*", root)
    return tables.scan(spark, "packets", root)


def _csv_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tables")
    csv.load_folder(spark, f"{_csv_folder(spark, sf_dir)}/*", root, only=["alerts"])
    return tables.scan(spark, "alerts", root)


def _csv_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either load of the same folder reports, and what is stored afterwards."""
    folder, root = f"{_csv_folder(spark, sf_dir)}/*", scratch_path(spark, "tables")
    made = []
    for load in ("first", "second"):
        report = cut_lineage(csv.load_folder(spark, folder, root))
        made.append(report.groupBy(F.lit(load).alias("load"), "table", "status").agg(F.sum("n_rows").alias("n_rows")))
    for table in TABLES:
        rows = tables.scan(spark, table, root)
        made.append(rows.select(F.lit("stored").alias("load"), F.lit(table).alias("table"), F.lit("stored").alias("status")).groupBy(
            "load", "table", "status").agg(F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionByName, made)


def _csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tables")
    csv.load_folder(spark, f"{_csv_folder(spark, sf_dir)}/*", root, only=["packets"])
    return tables.quarantine(spark, root).select("table", "line", "reason", "record")


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host_stats, corrected for some hosts and intervals, and with some more, written over the stored ones."""
    root, stats = scratch_path(spark, "tables"), cut_lineage(T.host_stats(spark, sf_dir))
    tables.merge_host_stats(stats, root)
    late = F.col("total_packets") % 3 == 0
    shifted = {c: F.col(c) + F.expr("interval 2 days") for c in ("interval_start", "interval_end")}
    corrected = stats.filter(late).withColumns({"total_packets": F.col("total_packets") + 1, "total_packets_size": F.col("total_packets_size") + 60})
    tables.merge_host_stats(corrected.unionByName(stats.filter(F.col("total_packets") % 3 == 1).withColumns(shifted)), root)
    return tables.scan(spark, "host_stats", root)


def _stored(table: str, source: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "tables")
        tables.append(source(spark, sf_dir), table, root)
        return tables.scan(spark, table, root)

    return run


def _burst_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    exports.burst_csv(A.scan_bursts(T.alerts(spark, sf_dir), gap_seconds=7200), path)
    names = exports.BURST_HEADER
    schema = f"`{names[0]}` string, `{names[1]}` timestamp_ntz, `{names[2]}` timestamp_ntz, `{names[3]}` bigint"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _url_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "urls")
    exports.write_csv(T.labelled_urls(spark, sf_dir).select("url", "type"), path)
    return csv.labelled_urls(spark, path)


BASELINE_SCHEMA = StructType([
    StructField("src_ip", StringType()), *[StructField(c, DoubleType()) for c in ("packet_rate", "unique_port_count", "avg_pkt_size")]
])


def _baseline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic features -> CSV -> numeric columns -> trained forest -> every row with its tag."""
    path = scratch_path(spark, "baseline")
    exports.write_csv(_features(spark, sf_dir).select(*BASELINE_SCHEMA.names), path)
    rows = csv.numeric_baseline(spark, path, BASELINE_SCHEMA)
    return anomaly.split_table(registry.train_behaviour("IsolationForest", rows, rows.columns), rows)


def _baseline_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(_baseline_csv(spark, sf_dir), "tag")


def _shares(rows: DataFrame, label: str) -> DataFrame:
    """How many rows have been labelled, and whether the share of anomalies is what the model was asked for."""
    flagged = F.count_if(F.col(label).cast("string").isin("-1", "Anomaly"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (flagged <= F.ceil(F.count(F.lit(1)) * 0.01) + 1).alias("as_asked"))


def _numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = T.table(spark, sf_dir, "supplier")
    return suppliers.select(*csv.numeric_columns(suppliers))


def source_queries() -> dict[str, Query]:
    return {
        "csv_route_report": _csv_report,
        "csv_route_load": _csv_loaded,
        "csv_over_lines": _csv_over_lines,
        "csv_load_twice": _csv_twice,
        "csv_quarantine": _csv_quarantine,
        "upsert_host_stats": _upserted,
        "insert_packets": _stored("packets", T.packets),
        "insert_alerts": _stored("alerts", T.alerts),
        "insert_host_stats": _stored("host_stats", T.host_stats),
        "csv_export": _burst_export,
        "json_rows": on(T.alerts, lambda d: exports.json_rows(A.top_sources(d))),
        "labelled_url_source": _url_csv,
        "numeric_baseline_columns": _numeric,
        "baseline_csv_tags": _baseline_csv,
        "baseline_csv_share": _baseline_share,
    }


# Detection with models ------------------------------------------------------------------------------


def _by_rule(rows: DataFrame) -> DataFrame:
    """A stand-in classifier that needs no training."""
    label = F.when(F.col("url").contains("?"), "phishing").when(F.col("url").contains("#"), "defacement")
    return rows.withColumn("prediction_label", label.otherwise("Benign"))


def _long_packets(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", F.when(F.col("pkt_len") > 1400, -1).otherwise(1))


def _detectors() -> list[S.Detector]:
    return [
        S.flood_detector(window_seconds=3600, threshold=1),
        S.url_detector(_by_rule, "DecisionTree"),
        S.behaviour_detector(_long_packets, "IsolationForest"),
    ]


FEATURES = ("packet_rate", "unique_port_count", "avg_pkt_size")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.traffic_features(T.packets(spark, sf_dir), seconds=T.STATS_SECONDS)


def _scored(name: str, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _features(spark, sf_dir)
        return registry.train_behaviour(name, rows, FEATURES, **params).score(rows)

    return run


#: Models written out, for results that need no training: two trees, six random features, 3-2-1-2-3 weights.
FIXED_SCALER = anomaly.Scaler(list(FEATURES), [0.02, 6.0, 770.0], [0.02, 4.0, 300.0])
FIXED_TREES = [
    # feature (-1: a leaf), split, left child (the right one follows), depth of a leaf
    ([0, 1, 2, -1, -1, -1, -1], [0.5, -0.5, 0.25, 0, 0, 0, 0], [1, 3, 5, -1, -1, -1, -1], [0, 0, 0, 2.0, 4.5, 3.0, 2.25]),
    ([2, -1, 0, -1, -1], [-0.75, 0, 1.0, 0, 0], [1, -1, 3, -1, -1], [0, 1.0, 0, 5.5, 2.0]),
]
FIXED_OMEGA = [[0.5, -1.0, 0.25, 0.75, -0.5, 1.5], [1.0, 0.5, -0.75, 0.25, 1.25, -0.25], [-0.5, 0.75, 1.0, -1.25, 0.5, 0.25]]
FIXED_PHASE = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
FIXED_WEIGHTS = [0.5, -0.25, 0.75, 0.25, -0.5, 1.0]
FIXED_LAYERS = [
    [[0.5, -0.25], [0.25, 0.5], [-0.5, 0.75]], [0.125, -0.125], [[0.5], [-0.75]], [0.25],
    [[1.0, -0.5]], [0.0, 0.5], [[0.5, 0.25, -0.25], [0.75, -0.5, 0.5]], [0.1371, 0.0, -0.125],
]


def fixed_model(name: str):
    if name == "IsolationForest":
        forest = [tuple(np.array(column) for column in tree) for tree in FIXED_TREES]
        return anomaly.IsolationForest(scaler=FIXED_SCALER, forest=forest, norm=4.0, threshold=-0.6)
    if name == "OneClassSVM":
        arrays = (np.array(v) for v in (FIXED_OMEGA, FIXED_PHASE, FIXED_WEIGHTS))
        omega, phase, weights = arrays
        return anomaly.OneClassSVM(
            features=6, scaler=FIXED_SCALER, omega=omega, phase=phase, weights=weights, threshold=0.1
        )
    return anomaly.Autoencoder(scaler=FIXED_SCALER, params=[np.array(v) for v in FIXED_LAYERS])


def _fixed(name: str, digits: int = 9) -> Query:
    """Scored by a model that is written out: the label, and the score to some digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = fixed_model(name).score(_features(spark, sf_dir))
        return scored.select("interval_start", "src_ip", F.round("score", digits).alias("score"), "prediction")

    return run


def _fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.split_table(fixed_model("IsolationForest"), _features(spark, sf_dir))


def _fixed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).select(
        F.col("interval_start").alias("ts"), "src_ip", F.lit(None).cast("string").alias("dst_ip"), *FEATURES
    )
    return S.behaviour_alerts(rows, fixed_model("IsolationForest").score, "IsolationForest")


def _trained_share(name: str) -> Query:
    return lambda spark, sf_dir: _shares(_scored(name)(spark, sf_dir), "prediction")


def _split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    return anomaly.split_table(registry.train_behaviour("IsolationForest", rows, FEATURES), rows)


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).select(
        F.col("interval_start").alias("ts"), "src_ip", F.lit(None).cast("string").alias("dst_ip"), *FEATURES
    )
    model = registry.train_behaviour("IsolationForest", rows, FEATURES)
    return S.behaviour_alerts(rows, model.score, "IsolationForest")


def _standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    scaled = anomaly.Scaler.fit(rows, FEATURES).transform(rows)
    return scaled.select("interval_start", "src_ip", *[F.round(c, 6).alias(c) for c in FEATURES])


# URL models -----------------------------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split.stratified_split(T.labelled_urls(spark, sf_dir))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urls.gram_weights(T.labelled_urls(spark, sf_dir), "page_id")
    return weights.withColumn("weight", F.round("weight", 9))


def _classified(name: str, **params) -> Query:
    """Trained on the training part, applied to the rest."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = split.stratified_split(T.learnable_urls(spark, sf_dir))
        model = registry.train_urls(name, train, **params)
        # Rows this short would by their size be one partition, and one task would judge them all.
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return urls.score(model, test.repartition(parts)).select("page_id", "type", "prediction_label")

    return run


def _sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label and whether its probability is over one half, which the URLs at hand leave no doubt of."""
    train, test = split.stratified_split(T.learnable_urls(spark, sf_dir))
    scored = urls.score(registry.train_urls("DecisionTree", train), test)
    chance = F.col("scores")[F.col("prediction_label")]
    return scored.select("page_id", "prediction_label", (chance > 0.5).alias("sure"), F.size("scores").alias("classes"))


def _trained_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.train_and_evaluate("DecisionTree", T.learnable_urls(spark, sf_dir)).report


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, store, choose, load the chosen model, predict."""
    root = scratch_path(spark, "models")
    rows = T.learnable_urls(spark, sf_dir)
    registry.save(spark, root, "DecisionTree", registry.train_urls("DecisionTree", rows))
    registry.choose(spark, root, "DecisionTree")
    model = registry.load(spark, root, registry.current(spark, root))
    return urls.score(model, rows).select("page_id", "type", "prediction_label")


def _url_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = registry.train_urls("DecisionTree", T.learnable_urls(spark, sf_dir))
    return S.url_alerts(T.url_packets(spark, sf_dir), lambda d: urls.score(model, d), "DecisionTree")


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scores(spark, sf_dir).select(
        F.col("toxic").cast("string").alias("label"),
        F.create_map(F.lit("0"), 1 - F.col("score"), F.lit("1"), F.col("score")).alias("scores"),
    )


def _points(df: DataFrame) -> DataFrame:
    finite = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return evaluate.roc_curve(df).withColumn("threshold", finite)


def _report(df: DataFrame) -> DataFrame:
    three = {c: F.round(c, 9) for c in ("precision", "recall", "f1_score")}
    return evaluate.classification_report(df).withColumns(three)


def ml_queries() -> dict[str, Query]:
    return {
        "url_rule_alerts": on(T.url_packets, S.url_alerts, classify=_by_rule, model_name="DecisionTree"),
        "behaviour_rule_alerts": on(T.packets, S.behaviour_alerts, score=_long_packets, model_name="IsolationForest"),
        "detector_union": on(T.url_packets, S.run_detectors, detectors=_detectors()),
        "char_ngram_tfidf": _grams,
        "stratified_split": _split,
        "confusion_matrix": on(T.class_scores, evaluate.confusion_matrix),
        "roc_curve": on(T.class_scores, _points),
        "roc_curve_binary": on(_binary, _points),
        "auc": on(T.class_scores, evaluate.auc),
        "auc_binary": on(_binary, evaluate.auc),
        "classification_report": on(T.class_scores, _report),
        "standardise": _standardised,
        "decision_tree_url": _classified("DecisionTree"),
        "random_forest_url": _classified("RandomForest"),
        "linear_svm_url": _classified("LinearSVM"),
        "predict_label_proba": _sure,
        "model_registry": _registered,
        "train_evaluate_report": _trained_report,
        "url_model_alerts": _url_alerts,
        "isolation_forest": _scored("IsolationForest"),
        "one_class_svm": _scored("OneClassSVM"),
        "autoencoder": _scored("Autoencoder"),
        "anomaly_split_table": _split_table,
        "behaviour_alerts": _behaviour,
        "isolation_forest_fixed": _fixed("IsolationForest"),
        "one_class_svm_fixed": _fixed("OneClassSVM"),
        "autoencoder_fixed": _fixed("Autoencoder", 6),  # many errors end in a 5 at the tenth digit
        "anomaly_split_table_fixed": _fixed_split,
        "behaviour_alerts_fixed": _fixed_alerts,
        "isolation_forest_share": _trained_share("IsolationForest"),
        "one_class_svm_share": _trained_share("OneClassSVM"),
    }


# Streams over the tables, run until their input is used up -------------------------------------------


def _streamed(start: Callable, source: str, shape: Callable[[DataFrame], DataFrame], *, state: bool = False,
              keys: tuple[str, ...] = (), plain: bool = False, without: str = "", **params) -> Query:
    """Run a stream over one test table and return what it wrote."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch_path(spark, start.__name__)
        places = [f"{base}/out", *([f"{base}/state"] if state else []), f"{base}/checkpoint"]
        query = start(shape(T.stream(spark, sf_dir, source)), *places, available_now=True, **params)
        query.awaitTermination()
        if keys:
            return core.newest_rows(spark, f"{base}/out", *keys).drop(without)
        return spark.read.parquet(f"{base}/out").drop(DAY) if plain else core.read_batches(spark, f"{base}/out")

    return run


def _scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "scored")
    model = registry.train_urls("DecisionTree", T.learnable_urls(spark, sf_dir))
    packets = T.url_packets_of(T.stream(spark, sf_dir, "pages"))
    live.scored_urls(packets, model, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("ts", "src_ip", "dst_ip", "url", "prediction_label")


def _fan_out(which: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch_path(spark, "fanout")
        registry.save(spark, f"{base}/models", "DecisionTree",
                      registry.train_urls("DecisionTree", T.learnable_urls(spark, sf_dir)))
        registry.choose(spark, f"{base}/models", "DecisionTree")
        packets = T.url_packets_of(T.stream(spark, sf_dir, "pages"))
        live.url_alerts(
            packets, f"{base}/models", f"{base}/alerts", f"{base}/sent", f"{base}/state", f"{base}/checkpoint",
            available_now=True,
        ).awaitTermination()
        return core.read_batches(spark, f"{base}/{which}")

    return run


def _behaviour_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "behaviour")
    packets = T.packets_of(T.stream(spark, sf_dir, "lineitem"))
    live.behaviour_alerts(
        packets, fixed_model("IsolationForest"), f"{base}/out", f"{base}/checkpoint", seconds=T.STATS_SECONDS, available_now=True
    ).awaitTermination()
    return core.read_batches(spark, f"{base}/out")


def _engine(which: str) -> Query:
    """The detectors of `detector_union` as a stream, with the throttle behind them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch_path(spark, "engine")
        packets = T.url_packets_of(T.stream(spark, sf_dir, "pages"))
        live.detector_engine(
            packets, _detectors()[1:], f"{base}/alerts", f"{base}/sent", f"{base}/state", f"{base}/checkpoint",
            window_seconds=3600, threshold=1, seconds=1800, available_now=True,
        ).awaitTermination()
        rows = core.read_batches(spark, f"{base}/{which}")
        # Which of several alerts of one moment is sent is open; that one is, is not.
        return rows.select("ts") if which == "sent" else rows

    return run


def _in_order(start: Callable, source: Callable[[SparkSession, str], DataFrame], *columns: str, **params) -> Query:
    """Run a stream whose clock goes on beating until all that waited has been written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch_path(spark, start.__name__)
        query = start(source(spark, sf_dir), f"{base}/out", f"{base}/state", f"{base}/check", idle_seconds=2, every="1 second", **params)
        ordered.drained(spark, query, f"{base}/state")
        rows = core.read_batches(spark, f"{base}/out")
        return rows.select(*columns) if columns else rows

    return run


def _sketched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the minutes of a stream, united into days."""
    minutes = _in_order(ordered.host_sketches, lambda s, d: T.packets_of(T.stream(s, d, "lineitem")))(spark, sf_dir)
    found = sketches.estimated(sketches.united(minutes, seconds=86400))
    return _beside_exact(found, T.host_stats(spark, sf_dir, seconds=86400))


def streaming_queries() -> dict[str, Query]:
    al, pk = T.alerts_of, T.packets_of
    return {
        "ingest_stream": _streamed(live.ingest, "lineitem", T.raw_packets_of, plain=True),
        "host_stats_stream": _streamed(live.host_stats, "lineitem", pk),
        "host_stats_idle_stream": _in_order(ordered.host_stats, lambda s, d: pk(T.stream(s, d, "lineitem"))),
        "ddos_rolling_stream": _in_order(ordered.rolling_type_count, lambda s, d: al(T.stream(s, d, "events"))),
        "rolling_30m_stream": _in_order(ordered.rolling_packets, lambda s, d: T.stats_stream(s, d, "rolling")),
        "new_source_spike_stream": _in_order(
            ordered.new_source_spike, lambda s, d: T.stats_stream(s, d, "spikes"),
            "host_ip", "interval_start", "unique_src_ips", "prev_src_ips", "new_src_jump",
        ),
        "quiet_periods_stream": _in_order(ordered.quiet_periods, lambda s, d: al(T.stream(s, d, "events")), min_minutes=2),
        "syn_flood_stream": _streamed(live.syn_flood_windows, "lineitem", pk, plain=True,
                                      window_seconds=60, threshold=2),
        "syn_flood_alert_stream": _streamed(live.syn_flood_alerts, "lineitem", pk, state=True,
                                            window_seconds=60, threshold=2),
        "throttle_stream": _streamed(live.notifications, "events", al, state=True),
        "throttle_keys_stream": _streamed(keyed.notifications, "events", al, plain=True, by=("alert_type", "src_ip"), ties=("alert_id",)),
        "host_sketch_stream": _sketched_days,
        "burst_stream": _streamed(live.scan_bursts, "events", al, plain=True, gap_seconds=7200),
        "dashboard_hours_stream": _streamed(live.dashboard_hours, "events", al, keys=("hour_bucket", "alert_type")),
        "dashboard_minutes_stream": _streamed(live.dashboard_minutes, "events", al, keys=("minute_bucket",)),
        "dashboard_sources_stream": _streamed(live.dashboard_sources, "events", al, keys=("since", "src_ip"), without="since"),
        "behaviour_stream": _behaviour_stream,
        "detector_engine_alerts": _engine("alerts"),
        "detector_engine_sent": _engine("sent"),
        "model_score_stream": _scored_stream,
        "alert_fanout_alerts": _fan_out("alerts"),
        "alert_fanout_sent": _fan_out("sent"),
    }


def _shipping(query: Query) -> Query:
    """Python workers need the package, wherever the driver was started."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    every = {
        **batch_queries(),
        **derivation_queries(),
        **source_queries(),
        **ml_queries(),
        **streaming_queries(),
    }
    return {name: _shipping(query) for name, query in every.items()}
