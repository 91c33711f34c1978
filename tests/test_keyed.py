"""The throttle with a state per key against the batch throttle, and keys that leave the state."""

import random

from netsight.operators import throttle
from netsight.streaming import keyed

ALERT = "alert_id long, alert_type string, src_ip string, details string"


def run(spark, tmp_path, frames, **params):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keyed.notifications(stream, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True, **params)
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")), states


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_against_batch(spark, at, tmp_path):
    r = random.Random(8)
    rows = [
        (r.randrange(0, 3_000_000) / 1000, i, r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.choice([None, "", 'q"\n\\ü']))
        for i in range(900)
    ]
    rows += [(t, 10_000 + i, *rest) for i, (t, _, *rest) in enumerate(rows[:100])]  # equal keys and times
    frames = [at([x for x in rows if 750 * k <= x[0] < 750 * (k + 1)], ALERT) for k in range(4)]
    keys = ["alert_type", "src_ip"]
    found, _ = run(spark, tmp_path, frames, by=keys, seconds=60, ties=["alert_id"])
    want = throttle.throttle(at(rows, ALERT), seconds=60, keys=keys, ties=["alert_id"])
    assert rows_of(found) == rows_of(want) and found.count() > 100


def test_idle_keys_leave_the_state(spark, at, tmp_path):
    frames = [at([(1000.0 * k, k, "a", f"h{k}{i}", "") for i in range(20)], ALERT) for k in range(5)]
    found, states = run(spark, tmp_path, frames, by=["src_ip"], seconds=60, delay_seconds=10)
    assert found.count() == 100
    assert max(states) <= 40 and states[-1] <= 20


def test_rows_without_a_time_and_late_rows(spark, at, tmp_path):
    untimed = at([(0, 9, "a", "x", "")], ALERT).selectExpr("cast(null as timestamp_ntz) as ts", "alert_id", "alert_type", "src_ip", "details")
    frames = [at([(0, 1, "a", "x", ""), (299, 2, "a", "x", "")], ALERT).unionByName(untimed)]
    frames += [at([(300, 3, "a", "x", ""), (5000, 4, "a", "x", "")], ALERT), at([(4000, 5, "a", "x", ""), (4000, 6, "b", "y", "")], ALERT)]
    frames += [at([(4500, 7, "b", "y", ""), (4600, 8, "c", "z", ""), (5300, 10, "a", "x", "")], ALERT)]
    found, _ = run(spark, tmp_path, frames, by=["src_ip"])
    # 6 comes in the batch after the one that moved the watermark past it, 7 and 8 later still.
    assert sorted(r.alert_id for r in found.collect()) == [1, 3, 4, 6, 10]
