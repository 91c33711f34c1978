"""Sketches that are stored and united: exact sums, bounded errors, and the same whatever the order of uniting."""

import random

import pytest
from pyspark.sql import functions as F

from netsight.operators import hosts, rollup, sketches
from netsight.streaming import core, ordered

PACKET = "src_ip string, dst_ip string, dst_port int, pkt_len int"


def many(spark, n):
    """n packets of an hour to one host, from n different sources, and a fifth as many ports."""
    ids = F.col("id")
    return spark.range(n).select(
        (F.lit("2024-01-01 05:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ids % 3600)).alias("ts"),
        F.concat(F.lit("s"), ids).alias("src_ip"), F.lit("hot").alias("dst_ip"),
        (1 + ids % (n // 5)).cast("int").alias("dst_port"), F.lit(60).alias("pkt_len"),
    )


@pytest.mark.parametrize("n", [50, 5_000, 60_000])
def test_hours_of_minutes_are_near_the_exact_counts(spark, n):
    packets = many(spark, n)
    minutes = sketches.host_sketches(packets)
    hour = sketches.estimated(sketches.united(minutes, seconds=3600)).filter("host_ip = 'hot'").first()
    error = 3 * sketches.relative_error()
    assert abs(hour.unique_src_ips - n) <= error * n + 0.5
    assert abs(hour.unique_dst_ports - n // 5) <= error * n / 5 + 0.5
    assert (hour.total_packets, hour.incoming_packets, hour.outgoing_packets, hour.total_packets_size) == (n, n, 0, 60 * n)


def test_a_row_is_bounded(spark):
    minutes = sketches.host_sketches(many(spark, 60_000), seconds=3600).filter("host_ip = 'hot'")
    (size,) = minutes.select(F.length("src_sketch")).first()
    assert size <= 2**sketches.BITS + 64
    plan = minutes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_uniting_in_steps_is_uniting_at_once(spark):
    minutes = sketches.host_sketches(many(spark, 5_000))
    once = sketches.united(minutes, seconds=86400)
    steps = sketches.united(sketches.united(minutes, seconds=3600), seconds=86400)
    rows = lambda d: sorted(map(repr, sketches.estimated(d).collect()))
    assert rows(once) == rows(steps)


def test_few_distinct_values_are_exact_and_answer_the_questions(at):
    r = random.Random(3)
    rows = [(r.randrange(7200), r.choice(["a", "b", "c", "", None]), r.choice("abd"), r.choice([None, 0, 80, 443]), r.choice([None, 60])) for _ in range(400)]
    packets = at(rows, PACKET)
    exact = rollup.host_stats(packets, seconds=600)
    near = sketches.estimated(sketches.united(sketches.host_sketches(packets), seconds=600))
    plain = lambda d: sorted(map(repr, d.select(*sorted(d.columns)).collect()))
    assert plain(near) == plain(exact)
    asked = dict(as_of="2024-01-01 02:00:00")
    assert plain(hosts.port_fan_out(near, **asked)) == plain(hosts.port_fan_out(exact, **asked))


def test_stored_days_are_pruned(spark, at, tmp_path):
    packets = at([(k * 43_200, "a", "b", 80, 60) for k in range(8)], PACKET)
    path = str(tmp_path / "kept")
    sketches.store(sketches.host_sketches(packets.limit(0)), path)
    sketches.store(sketches.host_sketches(packets), path)
    import datetime as dt

    since, until = at.start + dt.timedelta(days=1), at.start + dt.timedelta(days=2)
    found = sketches.stored(spark, path, since=since, until=until)
    assert sorted(at.seconds(t) for (t,) in found.select("interval_start").distinct().collect()) == [86_400, 129_600]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert sketches.stored(spark, path).count() == 16


def test_stream_gives_the_sketches_of_batch(spark, at, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(300), r.choice("abc"), r.choice("abd"), r.randrange(4), 60) for _ in range(300)]
    for k in range(3):  # an interval goes on over two batches
        at([x for x in rows if k * 100 <= x[0] < (k + 1) * 100], PACKET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(at([], PACKET).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state, check = (str(tmp_path / d) for d in ("out", "state", "check"))
    query = ordered.host_sketches(stream, out, state, check, idle_seconds=1, every="1 second")
    ordered.drained(spark, query, state, timeout=120)
    plain = lambda d: sorted(map(repr, sketches.estimated(d).collect()))
    assert plain(core.read_batches(spark, out)) == plain(sketches.host_sketches(at(rows, PACKET)))
