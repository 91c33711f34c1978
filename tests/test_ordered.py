"""Streams judged in the order of time: late rows, carried rows, and what goes out when nothing comes any more."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from netsight.operators import alerts as A
from netsight.operators import detect, hosts, rollup
from netsight.streaming import core, ordered

ALERT = "alert_type string, src_ip string"
PACKET = "src_ip string, dst_ip string, dst_port int, pkt_len int, tcp_flags string, full_url string"


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def batches(spark, tmp_path):
    """DataFrames as a stream, one micro-batch each in this order, whatever their times."""

    def make(*parts):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream, [str(tmp_path / d) for d in ("out", "state", "check")]

    return make


def test_rolling_counts_with_late_rows(spark, at, batches):
    r = random.Random(2)
    times = sorted(r.randrange(0, 40_000) / 10 for _ in range(600))
    parts = [[], [], [], []]
    for t in times:
        k = min(3, int(t // 1000))
        late = t % 1000 > 992 and k < 3 and r.random() < 0.7  # comes with the next batch, within the delay
        parts[k + late].append((t, r.choice(["DDoS", "DoS"]), "a"))
    frames = [at(p, ALERT) for p in parts]
    too_late = at([(5.0, "DDoS", "a"), (2500.0, "DDoS", "a")], ALERT)
    closing = at([(1_000_000, "DoS", "z")], ALERT)
    stream, (out, state, check) = batches(*frames[:3], frames[3].unionByName(too_late), closing)
    ordered.rolling_type_count(stream, out, state, check, idle_seconds=None, available_now=True).awaitTermination()
    every = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    assert rows_of(core.read_batches(spark, out)) == rows_of(A.rolling_type_count(every, ordered=False))
    assert core.Carried(f"{state}/rows").before(spark, 5).count() == 1  # the closing row waits, no other is held


def test_the_row_before_is_carried(spark, at, batches):
    r = random.Random(4)
    stats = [(3600.0 * i, h, 60 * (i + 1), r.randrange(8)) for i in range(30) for h in "abc" if r.random() < 0.6]
    start = at.start

    def frame(rows):
        data = [(start + dt.timedelta(seconds=t), start + dt.timedelta(seconds=t + 60), h, n, s) for t, h, n, s in rows]
        return spark.createDataFrame(data, "interval_start timestamp_ntz, interval_end timestamp_ntz, host_ip string, total_packets long, unique_src_ips long")

    cuts = [[s for s in stats if k * 36000 <= s[0] < (k + 1) * 36000] for k in range(3)]
    closing = frame([(10_000_000.0, "z", 1, 1)])
    stream, (out, state, check) = batches(*map(frame, cuts), closing)
    ordered.new_source_spike(stream, out, state, check, idle_seconds=None, available_now=True).awaitTermination()
    want = hosts.new_source_spike(frame(stats), as_of=start + dt.timedelta(days=2), hours=48)
    assert rows_of(core.read_batches(spark, out).drop("interval_end")) == rows_of(want) and want.count() > 5
    assert core.Carried(f"{state}/rows").before(spark, 4).count() == 4  # one of each host, and the closing row


def test_quiet_periods_and_rolling_packets_over_batches(spark, at, batches, tmp_path):
    times = [0, 700, 701, 3000, 3300, 9000, 9100]
    frames = [at([(t, "DoS", "a") for t in times[i : i + 2]], ALERT) for i in range(0, 7, 2)]
    stream, (out, state, check) = batches(*frames, at([(1_000_000, "DoS", "z")], ALERT))
    ordered.quiet_periods(stream, out, state, check, idle_seconds=None, available_now=True).awaitTermination()
    found = sorted((at.seconds(r.gap_start), at.seconds(r.gap_end)) for r in core.read_batches(spark, out).collect())
    assert found == [(0, 700), (701, 3000), (3300, 9000)]
    assert core.Carried(f"{state}/rows").before(spark, 5).count() == 2


def test_all_goes_out_when_nothing_comes(spark, at, batches):
    r = random.Random(5)
    rows = [(r.randrange(3000) / 10, r.choice("ab"), r.choice("abc"), r.randrange(4), 60, None, None) for _ in range(300)]
    frames = [at([x for x in rows if k * 100 <= x[0] < (k + 1) * 100], PACKET) for k in range(3)]
    stream, (out, state, check) = batches(*frames)
    query = ordered.host_stats(stream, out, state, check, idle_seconds=1, every="1 second")
    ordered.drained(spark, query, state, timeout=120)
    want = rollup.host_stats(frames[0].unionByName(frames[1]).unionByName(frames[2]))
    assert rows_of(core.read_batches(spark, out)) == rows_of(want)


def test_sums_apart_from_distinct_counts(at):
    r = random.Random(6)
    rows = [(r.randrange(3000) / 10, r.choice(["a", "b", "", None]), r.choice("abc"), r.choice([None, 0, 80]), r.choice([None, 60]), None, None) for _ in range(300)]
    stats = rollup.host_stats(at(rows, PACKET))
    totals = rollup.host_totals(at(rows, PACKET))
    assert rows_of(totals) == rows_of(stats.select(*totals.columns))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_detectors_share_one_pass(spark, at, tmp_path):
    r = random.Random(7)
    rows = [(r.randrange(60), r.choice("ab"), "c", 80, r.randrange(1500), r.choice(["0x0002", "0x0010", None]), r.choice([None, "", "http://x/?a", "http://y/"])) for _ in range(400)]
    at(rows, PACKET).write.parquet(str(tmp_path / "p"))
    packets = spark.read.parquet(str(tmp_path / "p"))
    classify = lambda d: d.withColumn("prediction_label", F.when(F.col("url").contains("?"), "phishing").otherwise("Benign"))
    score = lambda d: d.withColumn("prediction", F.when(F.col("pkt_len") > 1400, -1).otherwise(1))
    detectors = [detect.flood_detector(window_seconds=10, threshold=2), detect.url_detector(classify, "m"), detect.behaviour_detector(score, "n")]
    found = detect.run_detectors(packets, detectors)
    alone = [detect.syn_flood_alerts(packets, window_seconds=10, threshold=2), detect.url_alerts(packets, classify, "m"), detect.behaviour_alerts(packets, score, "n")]
    assert rows_of(found) == rows_of(alone[0].unionByName(alone[1]).unionByName(alone[2])) and found.count() > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path / "p") not in plan  # all read what the one pass has stored
    single = detect.run_detectors(packets, detectors[1:])
    assert single._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
