"""Streams over several micro-batches against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from netsight.functions.derive import dissect, valid_ip_rows
from netsight.ml import registry
from netsight.operators import alerts as A
from netsight.operators import detect, rollup, throttle
from netsight.plans import driver_tables
from netsight.session import passing_steps
from netsight.sources.tables import conform
from netsight.streaming import core, live

PACKET = "src_ip string, dst_ip string, dst_port int, pkt_len int, tcp_flags string, full_url string"
ALERT = "alert_type string, src_ip string, dst_ip string, details string"


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def streamed(spark, tmp_path):
    """The rows of a DataFrame as a stream, one part of the time line per micro-batch."""

    def make(df, parts):
        src = str(tmp_path / "in")
        low, high = df.agg(F.min("ts"), F.max("ts")).first()
        step = (high - low) / parts
        for i in range(parts):
            last = F.col("ts") <= F.lit(high) if i == parts - 1 else F.col("ts") < F.lit(low + step * (i + 1))
            df.filter((F.col("ts") >= F.lit(low + step * i)) & last).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        return stream, [str(tmp_path / d) for d in ("out", "state", "check")]

    return make


def packets(at, seconds=600, n=400):
    rng = random.Random(9)
    rows = [(rng.randrange(seconds * 10) / 10, rng.choice("ab"), rng.choice("abc"), rng.randrange(4), 60, "0x0002",
             rng.choice([None, "http://x7/?a=7", "http://x8/"])) for _ in range(n)]
    return at(rows, PACKET)


def test_host_stats_with_a_closing_row(at, streamed):
    df = packets(at)
    done = df.unionByName(at([(100000, "z", "z", 1, 1, None, None)], PACKET))  # moves the watermark past all
    stream, (out, _, check) = streamed(done, 4)
    live.host_stats(stream, out, check, available_now=True).awaitTermination()
    assert rows_of(core.read_batches(df.sparkSession, out)) == rows_of(rollup.host_stats(df))


def test_syn_windows(at, streamed):
    df = packets(at, seconds=60)
    done = df.unionByName(at([(100000, "z", "z", 1, 1, "0x0002", None)], PACKET))
    stream, (out, _, check) = streamed(done, 3)
    live.syn_flood_windows(stream, out, check, available_now=True).awaitTermination()
    assert rows_of(df.sparkSession.read.parquet(out)) == rows_of(detect.syn_flood_windows(df))


def test_syn_alerts_count_on_across_batches(spark, at, tmp_path):
    df = packets(at, seconds=30, n=300)
    # Batches cut inside windows.
    src = str(tmp_path / "in")
    for i in range(6):
        part = df.filter((F.col("ts") >= F.lit(at.start) + F.expr(f"interval {i * 5.5} seconds"))
                         & (F.col("ts") < F.lit(at.start) + F.expr(f"interval {i * 5.5 + 5.5} seconds")))
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    live.syn_flood_alerts(stream, out, str(tmp_path / "state"), str(tmp_path / "check"), available_now=True).awaitTermination()
    got, want = core.read_batches(spark, out), detect.syn_flood_alerts(df)
    # Which packet of a window comes first differs with arrival; how many alert does not.
    key = [F.window("ts", "1 second").alias("w"), "src_ip"]
    assert rows_of(got.groupBy(*key).count()) == rows_of(want.groupBy(*key).count()) and want.count() > 0


def test_throttle_goes_on_across_batches(at, streamed):
    rng = random.Random(5)
    df = at([(rng.randrange(6000), rng.choice(["DDoS", "DoS"]), rng.choice("ab"), "d", "x") for _ in range(300)], ALERT)
    stream, (out, state, check) = streamed(df, 5)
    live.notifications(stream, out, state, check, available_now=True).awaitTermination()
    assert rows_of(core.read_batches(df.sparkSession, out)) == rows_of(throttle.throttle(df))


def test_throttle_of_all_alerts_as_one_line(at, streamed):
    df = at([(s, "DoS", "a", "d", "x") for s in (0, 100, 299, 300, 500, 599, 600, 950)], ALERT)
    stream, (out, state, check) = streamed(df, 3)
    live.notifications(stream, out, state, check, keys=throttle.SINGLE_KEY, available_now=True).awaitTermination()
    assert sorted(at.seconds(r.ts) for r in core.read_batches(df.sparkSession, out).collect()) == [0, 300, 600, 950]


def test_bursts(at, streamed):
    rng = random.Random(6)
    df = at([(rng.randrange(4000), "Port Scan", rng.choice("ab"), "d", "x") for _ in range(200)], ALERT)
    done = df.unionByName(at([(100000, "Port Scan", "z", "d", "x")], ALERT))
    stream, (out, _, check) = streamed(done, 4)
    live.scan_bursts(stream, out, check, available_now=True).awaitTermination()
    assert rows_of(df.sparkSession.read.parquet(out)) == rows_of(A.scan_bursts(df))


def test_dashboards(spark, at, streamed, tmp_path):
    rng = random.Random(7)
    df = at([(rng.randrange(9000), rng.choice(["DDoS", "Port Scan"]), rng.choice("abc"), "d", "x") for _ in range(200)], ALERT)
    stream, _ = streamed(df, 3)
    for start, want, keys in [
        (live.dashboard_hours, A.alerts_by_hour(df, hours=99), ("hour_bucket", "alert_type")),
        (live.dashboard_minutes, A.alerts_per_minute(df), ("minute_bucket",)),
        (live.dashboard_sources, A.top_sources(df), ("since", "src_ip")),
    ]:
        place = str(tmp_path / start.__name__)
        start(stream, f"{place}/out", f"{place}/check", available_now=True).awaitTermination()
        assert rows_of(core.newest_rows(spark, f"{place}/out", *keys).drop("since")) == rows_of(want)


def test_ingest(spark, at, streamed):
    rows = [(i, "TCP", None, "1.1.1.1" if i % 3 else "bad", "2.2.2.2", "1", "2", "60", "0x0002", True, "h", None, "/u", None)
            for i in range(30)]
    cols = ("transport_layer string, highest_layer string, src_ip string, dst_ip string, src_port string, dst_port string, "
            "length string, tcp_flags string, has_http boolean, http_host string, http_full_uri string, http_uri string, tls_sni string")
    raw = at(rows, cols)
    stream, (out, _, check) = streamed(raw, 2)
    live.ingest(stream, out, check, available_now=True).awaitTermination()
    got = spark.read.parquet(out).drop("event_date")
    assert rows_of(got) == rows_of(conform(valid_ip_rows(dissect(raw)), "packets")) and got.count() == 20


def test_alerts_of_the_chosen_model(spark, at, streamed, tmp_path):
    urls = [(f"http://x{i}/?a={i}", "phishing") for i in range(20)] + [(f"http://x{i}/", "benign") for i in range(20)]
    models = str(tmp_path / "models")
    train = spark.createDataFrame(urls, "url string, type string")
    registry.save(spark, models, "DecisionTree", registry.train_urls("DecisionTree", train))
    df = packets(at, n=60)
    stream, (out, state, check) = streamed(df, 2)
    sent = str(tmp_path / "sent")
    live.url_alerts(stream, models, out, sent, state, check, available_now=True).awaitTermination()
    got = core.read_batches(spark, out)
    assert got.count() == df.filter("full_url like '%?%'").count() > 0
    assert {(r.alert_type, r.model_name) for r in got.collect()} == {("phishing", "DecisionTree")}
    assert rows_of(core.read_batches(spark, sent)) == rows_of(throttle.throttle(got))


def test_state_does_not_grow_with_time(spark, at, tmp_path):
    """Hourly batches of new sources: what the throttle carries stays flat, and so do its folders."""
    sizes, state = [], core.Carried(str(tmp_path / "state"))
    for hour in range(6):
        rows = at([(3600 * hour + i, "DoS", f"h{hour}-{i}", "d", "x") for i in range(100)], ALERT)
        with passing_steps(spark):
            live._throttled(rows, state, hour, ("src_ip",), 300, 10).count()
        sizes.append(state.before(spark, hour + 1).count())
        folders = [p.name for p in (tmp_path / "state").iterdir()]
        assert sorted(folders) == [f"batch_id={b}" for b in range(max(0, hour - 1), hour + 1)]
    assert sizes == [100] * 6


def test_a_stream_leaves_no_steps(spark, at, streamed):
    from pathlib import Path

    from netsight.session import shared_dir

    before = set(Path(shared_dir(spark)).glob("netsight/step-*"))
    df = at([(s, "DoS", "a", "d", "x") for s in range(0, 3000, 50)], ALERT)
    stream, (out, state, check) = streamed(df, 3)
    live.notifications(stream, out, state, check, available_now=True).awaitTermination()
    after = set(Path(shared_dir(spark)).glob("netsight/step-*"))
    throttled = rows_of(core.read_batches(spark, out))
    assert after == before and throttled == rows_of(throttle.throttle(df))


def test_folding_a_dashboard(spark, tmp_path):
    place = str(tmp_path / "t")
    for b in range(5):
        core.write_batch(spark.createDataFrame([("a", b), (f"k{b}", b)], "k string, n int"), place, b)
    want = rows_of(core.newest_rows(spark, place, "k"))
    for _ in range(2):  # a replay of the batch that folds
        core.compact(spark, place, ["k"], 4)
        assert rows_of(core.newest_rows(spark, place, "k")) == want
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["batch_id=3", "batch_id=4"]


def test_engine_is_the_union_of_the_detectors(spark, at, streamed, tmp_path):
    df = packets(at, seconds=3000, n=300).withColumn("ts", F.col("ts"))
    by_url = lambda p: detect.url_alerts(
        p, lambda d: d.withColumn("prediction_label", F.when(F.col("url").contains("?"), "phishing").otherwise("benign")), "DecisionTree"
    )
    stream, (out, state, check) = streamed(df, 4)
    sent = str(tmp_path / "sent")
    live.detector_engine(stream, [by_url], out, sent, state, check, window_seconds=60, threshold=1, available_now=True).awaitTermination()
    want = detect.run_detectors(df, [lambda p: detect.syn_flood_alerts(p, window_seconds=60, threshold=1), by_url])
    got = core.read_batches(spark, out)
    assert got.count() == want.count() > 0
    assert rows_of(got.filter("model_name != 'SynFlood'")) == rows_of(want.filter("model_name != 'SynFlood'"))
    times = sorted({at.seconds(r.ts) for r in got.collect()})
    passed = []
    for t in times:
        if not passed or t - passed[-1] >= 300:
            passed.append(t)
    assert sorted(at.seconds(r.ts) for r in core.read_batches(spark, sent).collect()) == passed


@pytest.mark.parametrize("by_registry", [False, True])
def test_behaviour_models_on_the_stream(spark, at, streamed, tmp_path, by_registry):
    from netsight.ml import anomaly

    columns = ["packet_rate", "unique_port_count", "avg_pkt_size"]
    df = packets(at)
    done = df.unionByName(at([(100000, "z", "z", 1, 1, None, None)], PACKET))
    features = rollup.traffic_features(df)
    model = anomaly.IsolationForest(trees=10, contamination=0.1).fit(features, columns)
    root = str(tmp_path / "models")
    registry.save(spark, root, "IsolationForest", model)
    registry.choose(spark, root, "IsolationForest")
    stream, (out, _, check) = streamed(done, 4)
    live.behaviour_alerts(stream, root if by_registry else model, out, check, available_now=True).awaitTermination()
    flagged = model.score(features).filter("prediction = -1").select("interval_start", "src_ip").collect()
    assert sorted((r.ts, r.src_ip) for r in core.read_batches(spark, out).collect()) == sorted(map(tuple, flagged)) != []


def test_a_retrained_model_is_loaded_again(spark, tmp_path):
    from netsight.ml import anomaly

    columns = ["a", "b"]
    rows = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "a double, b double")
    root, chosen = str(tmp_path), live._Chosen(str(tmp_path))
    registry.choose(spark, root, "IsolationForest")
    for trees in (2, 3):
        registry.save(spark, root, "IsolationForest", anomaly.IsolationForest(trees=trees).fit(rows, columns))
        name, model = chosen.now(spark)
        assert name == "IsolationForest" and len(model.forest) == trees and chosen.now(spark)[1] is model


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    place, carried = str(tmp_path / "t"), core.Carried(str(tmp_path / "s"))
    for _ in range(2):
        core.write_batch(spark.range(3), place, 0)
    assert core.read_batches(spark, place).count() == 3
    assert carried.before(spark, 0) is None
    carried.store(spark.range(2), 0)
    assert carried.before(spark, 1).count() == 2


@pytest.mark.parametrize("skewed", [False, True])
def test_a_part_of_a_streamed_table_is_several_files_and_one_batch(spark, tmp_path, skewed):
    at = F.when(F.col("id") == 0, 0).otherwise(399) if skewed else F.col("id") % 400
    rows = spark.range(0, 4000, numPartitions=6)
    seen = {}

    def write(batch, number):
        seen[number] = batch.select("id", at.alias("at"), F.input_file_name().alias("file")).collect()

    stream = driver_tables.stream_of(rows, at, "test")
    core.start_batches(stream, write, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3]
    assert all(r["at"] // 100 == number for number, found in seen.items() for r in found)
    assert sorted(r["id"] for found in seen.values() for r in found) == list(range(4000))
    assert len({r["file"] for r in seen[3]}) == 6
