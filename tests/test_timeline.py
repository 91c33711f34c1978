"""Scalable forms against their definitions, with edges and busy keys."""

import random

import pytest
from pyspark.sql import functions as F

from netsight.functions.timefn import floor_div
from netsight.operators import alerts, hosts, timeline


def random_rows(seed, n=400, span=5000, keys=("a", "b")):
    rng = random.Random(seed)
    # Half the rows at a few busy moments, with peers.
    moments = [rng.randrange(span) for _ in range(5)]
    return [
        (rng.choice(moments) if rng.random() < 0.5 else rng.randrange(span * 10) / 10, rng.choice(keys), rng.randrange(5))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_total_is_the_range_frame(at, seed):
    rows = random_rows(seed)
    df = at(rows, "k string, v int")
    got = timeline.repeat_rows(timeline.rolling_total(df, "ts", 600, F.col("v"), ["k"]), timeline.COPIES)
    want = sorted((s, k, sum(v for s2, k2, v in rows if k2 == k and s - 600 <= s2 <= s)) for s, k, _ in rows)
    assert sorted((at.seconds(r.ts), r.k, r.total) for r in got.collect()) == want


def test_rolling_frame_edges_and_peers(at):
    df = at([(0, "DDoS"), (600, "DoS"), (600, "DDoS"), (600.000001, "DoS"), (1200, "DDoS")], "alert_type string")
    got = [(at.seconds(r.ts), r.ddos_window) for r in alerts.rolling_type_count(df).collect()]
    assert got == [(0, 1), (600, 2), (600, 2), (600.000001, 1), (1200, 2)]


def test_alerts_without_a_time_keep_their_rows(at):
    df = at([(0, "DDoS"), (300, "DoS")], "alert_type string")
    timeless = df.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    got = alerts.rolling_type_count(df.unionByName(timeless)).collect()
    assert sorted(((r.ts is None, r.ts and at.seconds(r.ts)), r.ddos_window) for r in got if r.ts) == [((False, 0), 1), ((False, 300), 1)]
    assert [r.ddos_window for r in got if r.ts is None] == [1, 1]


def test_whole_division_is_exact(spark):
    big = [2**62 + 7, -(2**62) - 7, 2**53 + 1, -1, 0, 299, 300]
    rows = spark.createDataFrame([(v,) for v in big], "v bigint")
    assert [r[0] for r in rows.select(floor_div(F.col("v"), 300)).collect()] == [v // 300 for v in big]


def test_rolling_total_of_unknown_values(at):
    df = at([(0, None), (10, 5), (700, None)], "v int")
    got = timeline.rolling_total(df, "ts", 600, F.col("v")).orderBy("ts").collect()
    assert [r.total for r in got] == [None, 5, None]


def test_rolling_needs_whole_seconds(at):
    with pytest.raises(ValueError):
        timeline.rolling_total(at([(0,)], ""), "ts", 0.5, F.lit(1))


def test_repeat_rows_splits_large_counts(spark):
    df = spark.createDataFrame([("few", 3), ("many", timeline.CHUNK * 2 + 7)], "k string, n bigint")
    got = {r.k: r["count"] for r in timeline.repeat_rows(df, "n").groupBy("k").count().collect()}
    assert got == {"few": 3, "many": timeline.CHUNK * 2 + 7}


@pytest.mark.parametrize("seed", [3, 4])
def test_previous_value_is_lag(at, seed):
    rows = sorted(set((s, k, i) for i, (s, k, _) in enumerate(random_rows(seed, span=20000))))
    df = at(rows, "k string, i int")
    got = timeline.previous_value(df, "ts", ["i"], ["k"], span_seconds=300, ties=["i"])
    want = {}
    for k in ("a", "b"):
        last = None
        for _, _, i in sorted((r for r in rows if r[1] == k), key=lambda r: (r[0], r[2])):
            want[i], last = last, i
    assert {r.i: r.previous and r.previous.i for r in got.collect()} == want


@pytest.mark.parametrize("seed", [5, 6])
def test_bursts_by_definition(at, seed):
    rows = random_rows(seed, n=300, span=9000)
    got = timeline.bursts(at(rows, "k string, v int"), "ts", "k", 30, 2).collect()
    want = set()
    for k in ("a", "b"):
        run = []
        for s in [*sorted(s for s, k2, _ in rows if k2 == k), None]:
            if run and (s is None or s - run[-1] > 30):
                if len(run) >= 2:
                    want.add((k, run[0], run[-1], len(run)))
                run = []
            run.append(s)
    assert {(r.k, at.seconds(r.burst_start), at.seconds(r.burst_end), r.n) for r in got} == want


def test_a_pause_of_exactly_the_gap_stays_in_the_burst(at):
    scans = at([(0, "Port Scan", "x"), (30, "Port Scan", "x"), (60, "Port Scan", "x"), (90.000001, "Port Scan", "x"),
                (10, "DoS", "x"), (0, "Port Scan", "y")], "alert_type string, src_ip string")
    got = alerts.scan_bursts(scans).collect()
    assert [(r.src_ip, at.seconds(r.burst_start), at.seconds(r.burst_end), r.scans_in_burst) for r in got] == [("x", 0, 60, 3)]


@pytest.mark.parametrize("seed", [7, 8])
def test_silences_by_definition(at, seed):
    seconds = [s for s, _, _ in random_rows(seed, n=60, span=40000)]
    got = timeline.silences(at([(s,) for s in seconds], ""), "ts", 600).collect()
    line = sorted(seconds)
    want = sorted((a, b) for a, b in zip(line, line[1:]) if b - a >= 600)
    assert sorted((at.seconds(r.gap_start), at.seconds(r.gap_end)) for r in got) == want


def test_silence_of_exactly_ten_minutes_counts(at):
    got = alerts.quiet_periods(at([(0,), (600,), (1199.999999,)], "")).collect()
    assert [(at.seconds(r.gap_start), r.silence_seconds) for r in got] == [(0, 600.0)]


def test_mean_gap_telescopes(at):
    rows = [(0, "A"), (10, "A"), (40, "A"), (5, "B"), (7, "C"), (7, "C")]
    got = {r.alert_type: r.avg_gap_seconds for r in alerts.avg_alert_gap(at(rows, "alert_type string")).collect()}
    assert got == {"A": 20.0, "C": 0.0, "ALL TYPES": 8.0}  # one alert of a type has no gap


def test_source_spike_ignores_intervals_before_the_look_back(spark, at):
    rows = [(0, 1), (1800, 50), (3600, 52), (5400, 53)]
    stats = at(rows, "unique_src_ips bigint").select(
        F.col("ts").alias("interval_start"), (F.col("ts") + F.expr("interval 30 minutes")).alias("interval_end"),
        F.lit("h").alias("host_ip"), "unique_src_ips",
    )
    everything = hosts.new_source_spike(stats, hours=12).collect()
    assert [(r.prev_src_ips, r.new_src_jump) for r in everything] == [(1, 49), (50, 2)]
    recent = hosts.new_source_spike(stats, hours=1).collect()
    assert [(r.prev_src_ips, r.new_src_jump) for r in recent] == [(50, 2)]


def test_heavy_outgoing_without_incoming(spark, at):
    stats = at([(0, "a", 0, 5), (0, "b", 4, 10), (0, "c", 3, 3)], "host_ip string, incoming_packets bigint, outgoing_packets bigint")
    stats = stats.withColumnRenamed("ts", "interval_end")
    zero = hosts.heavy_outgoing(stats)
    assert [(r.host_ip, r.out_in_ratio) for r in zero.collect()] == [("b", 2.5), ("c", 1.0), ("a", 0.0)]
    null = hosts.heavy_outgoing(stats, factor=2, null_ratio_as_zero=False)
    assert [(r.host_ip, r.out_in_ratio) for r in null.collect()] == [("a", None), ("b", 2.5)]


def test_avg_packet_size_of_a_silent_host_comes_first(spark):
    stats = spark.createDataFrame([("a", 100, 10), ("b", 0, 0)], "host_ip string, total_packets_size bigint, total_packets bigint")
    got = [(r.host_ip, r.avg_pkt_size_bytes) for r in hosts.avg_packet_size(stats).collect()]
    assert got == [("b", None), ("a", 10.0)]


def test_flood_details_without_a_number_are_null(at):
    rows = [(0, 1, "DDoS", "7 packets"), (1, 2, "DDoS", "many packets"), (2, 3, "DDoS", "20 sources, 4000 packets -> x")]
    df = at(rows, "alert_id bigint, alert_type string, details string").withColumns({"src_ip": F.lit("s"), "dst_ip": F.lit("d")})
    assert [(r.alert_id, r.packet_count) for r in alerts.heaviest_floods(df).collect()] == [(3, 4000), (1, 7), (2, None)]
