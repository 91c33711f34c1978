"""Records over line ends, repeated and broken loads, quarantine, and statistics that are corrected."""

import csv as plain_csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from netsight.sources import csv, tables
from netsight.sources.schemas import ALERTS, HOST_STATS

HEAD = ",".join(ALERTS.names)


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        (tmp_path / "in").mkdir(exist_ok=True)
        for name, text in files.items():
            (tmp_path / "in" / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path / "in")

    return write


def report(df):
    return {r.file: (r.table, r.status, r.n_rows) for r in df.collect()}


def details(spark, root):
    return sorted((r.alert_type, r.details) for r in tables.scan(spark, "alerts", root).collect())


PIECES = ["x", "a b", ",", "\n", "\r\n", "\r", '"', '""', '"\n"', "\n\n", "1,2\n3,4", '",', "é", " "]


def file_of(r, n, end, name):
    """Lines by the csv module, which quotes where needed; every text with its number first, so that none is blank."""
    out = io.StringIO(newline="")
    write = plain_csv.writer(out, lineterminator=end, quoting=r.choice([plain_csv.QUOTE_MINIMAL, plain_csv.QUOTE_ALL]))
    rows = []
    for i in range(n):
        text = f"{i}" + "".join(r.choice(PIECES) for _ in range(r.randint(0, 6))) + "."
        rows.append((name, text))
        write.writerow(["2024-01-01 00:00:00", name, "1.1.1.1", "2.2.2.2", text, "m"])
    return HEAD + end + out.getvalue(), rows


@pytest.mark.parametrize("split", ["1000000", "200", "37"])
def test_values_over_line_ends(spark, folder, tmp_path, split):
    """However the files are cut into splits."""
    r, files, expected = random.Random(int(split)), {}, []
    for k in range(6):
        files[f"f{k}"], rows = file_of(r, 40, r.choice(["\n", "\r\n"]), f"f{k}")
        expected += rows
    files["plain"] = f"{HEAD}\n" + "2024-01-01 00:00:00,plain,a,b,c,m\n" * 3
    expected += [("plain", "c")] * 3
    source, root = folder(**files), str(tmp_path / "out")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = report(csv.load_folder(spark, source, root))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {f"f{k}.csv": ("alerts", "loaded", 40) for k in range(6)} | {"plain.csv": ("alerts", "loaded", 3)}
    assert details(spark, root) == sorted(expected)


def test_marks_inside_plain_values_open_nothing(spark, folder, tmp_path):
    line = "2024-01-01 00:00:00,k,1.1.1.1,2.2.2.2,{},m\n"
    texts = ['5" disk', 'it said "no"', '"a" b', '"a ""b"" c"', '"two\nlines ""x"""', 'z"']
    source, root = folder(odd=HEAD + "\n" + "".join(map(line.format, texts))), str(tmp_path / "out")
    assert report(csv.load_folder(spark, source, root)) == {"odd.csv": ("alerts", "loaded", 6)}
    found = {d for _, d in details(spark, root)}
    assert {'5" disk', 'it said "no"', 'a "b" c', 'two\nlines "x"', 'z"'} <= found


def test_quarantine(spark, folder, tmp_path):
    good = "2024-01-01 00:00:00,k,1.1.1.1,2.2.2.2,{},m\n"
    source = folder(
        a=HEAD + "\n" + good.format('"over\ntwo\n\nlines"') + "\n" + "soon,k,1,2,x,m\n" + good.format("y") + "2024-01-01 00:00:00,k,1\n",
        b=HEAD + "\n" + good.format("x") + good.format('"never closed') + good.format("y"),
        c=HEAD + "\n" + good.format("x"),
    )
    root = str(tmp_path / "out")
    assert report(csv.load_folder(spark, source, root)) == {
        "a.csv": ("alerts", "rejected", 0), "b.csv": ("alerts", "rejected", 0), "c.csv": ("alerts", "loaded", 1),
    }
    found = {(r.file, r.line): (r.table, r.reason, r.record) for r in tables.quarantine(spark, root).collect()}
    assert found == {
        ("a.csv", 7): ("alerts", "ts: not a timestamp_ntz", "soon,k,1,2,x,m"),
        ("a.csv", 9): ("alerts", "wrong number of values", "2024-01-01 00:00:00,k,1"),
        ("b.csv", 3): ("alerts", "unclosed quote", good.format('"never closed').strip()),
    }
    assert details(spark, root) == [("k", "x")]


def test_loading_twice_adds_nothing(spark, folder, tmp_path):
    line = "2024-01-01 00:00:00,k,1.1.1.1,2.2.2.2,x,m\n"
    source = folder(a=f"{HEAD}\n{line}", bad=f"{HEAD}\nx\n", other="q,r\n1,2\n")
    root = str(tmp_path / "out")
    csv.load_folder(spark, source, root)
    assert report(csv.load_folder(spark, source, root)) == {
        "a.csv": (None, "repeated", 0), "bad.csv": (None, "repeated", 0), "other.csv": (None, "skipped", 0),
    }
    folder(new=f"{HEAD}\n{line}{line}", bad=f"{HEAD}\n{line}")
    assert report(csv.load_folder(spark, source, root)) == {
        "a.csv": (None, "repeated", 0), "bad.csv": ("alerts", "loaded", 1), "new.csv": ("alerts", "loaded", 2), "other.csv": (None, "skipped", 0),
    }
    assert tables.scan(spark, "alerts", root).count() == 4
    files = {(r.path.rsplit("/", 1)[1], r.status, r.n_rows) for r in tables.loaded_files(spark, root).collect()}
    assert {("a.csv", "loaded", 1), ("bad.csv", "rejected", 0), ("bad.csv", "loaded", 1), ("new.csv", "loaded", 2)} <= files


def test_a_load_that_dies_shows_nothing(spark, folder, tmp_path, monkeypatch):
    line = "2024-01-01 00:00:00,k,1.1.1.1,2.2.2.2,x,m\n"
    source = folder(a=f"{HEAD}\n{line}", bad=f"{HEAD}\nx\n")
    root = str(tmp_path / "out")
    tables.append(spark.createDataFrame([(dt.datetime(2024, 1, 1), "old")], "ts timestamp_ntz, alert_type string"), "alerts", root)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "finish", die)
        with pytest.raises(RuntimeError, match="lost"):
            csv.load_folder(spark, source, root)
    assert [r.alert_type for r in tables.scan(spark, "alerts", root).collect()] == ["old"]
    assert tables.quarantine(spark, root).count() == tables.loaded_files(spark, root).count() == 0
    assert len(tables.clear_unfinished(spark, root)) == 1 and tables.clear_unfinished(spark, root) == []
    assert report(csv.load_folder(spark, source, root)) == {"a.csv": ("alerts", "loaded", 1), "bad.csv": ("alerts", "rejected", 0)}
    assert tables.scan(spark, "alerts", root).count() == 2 and tables.quarantine(spark, root).count() == 1


def stats(spark, rows):
    """(day, host, packets)"""
    start = dt.datetime(2024, 1, 1)
    data = [
        (None if d is None else start + dt.timedelta(days=d), None if d is None else start + dt.timedelta(days=d, minutes=1), h, n, n, 0, 1, 1, 60 * n)
        for d, h, n in rows
    ]
    return spark.createDataFrame(data, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HOST_STATS.fields))


def stored(spark, root):
    start = dt.datetime(2024, 1, 1)
    rows = tables.scan(spark, "host_stats", root).collect()
    return sorted(((None if r.interval_start is None else (r.interval_start - start).days, r.host_ip, r.total_packets) for r in rows), key=str)


def test_corrected_statistics_take_the_place_of_the_old(spark, tmp_path):
    root = str(tmp_path)
    tables.merge_host_stats(stats(spark, [(0, "a", 1), (0, "b", 2), (1, "a", 3), (2, None, 4), (0, "a", 9)]), root)
    assert stored(spark, root) == sorted([(0, "a", 9), (0, "b", 2), (1, "a", 3), (2, None, 4)], key=str)
    before = {f for f in (tmp_path / "host_stats").rglob("*.parquet")}
    tables.merge_host_stats(stats(spark, [(0, "b", 1), (2, None, 5), (3, "c", 6), (None, "n", 1)]), root)
    assert stored(spark, root) == sorted([(0, "a", 9), (0, "b", 1), (1, "a", 3), (2, None, 5), (3, "c", 6), (None, "n", 1)], key=str)
    new = {f for f in (tmp_path / "host_stats").rglob("*.parquet")} - before
    assert not any("event_date=2024-01-02" in str(f) for f in new)  # a day that nothing touches is not written again
    tables.merge_host_stats(stats(spark, []), root)
    assert len(stored(spark, root)) == 6
    tables.append(stats(spark, [(0, "a", 2)]), "host_stats", root)
    assert (0, "a", 2) in stored(spark, root) and (0, "a", 9) in stored(spark, root)


def test_a_scan_of_few_days_reads_few_days(spark, tmp_path):
    tables.merge_host_stats(stats(spark, [(d, "a", d + 1) for d in range(5)]), str(tmp_path))
    df = tables.scan(spark, "host_stats", str(tmp_path), days=[dt.date(2024, 1, 2)])
    assert [r.total_packets for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "event_date" in plan
    assert df.select(F.count("*")).first()[0] == 1
