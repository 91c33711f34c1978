import datetime as dt

import pytest
from pyspark.sql import functions as F

from netsight.operators import alerts as A
from netsight.sources import csv, exports, tables
from netsight.sources.schemas import ALERTS, BASELINE, HOST_STATS, PACKETS, subset

HEAD = ",".join(ALERTS.names)


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path)

    return write


def loaded(report):
    return {r.file: (r.table, r.status, r.n_rows) for r in report.collect()}


def test_files_go_where_their_header_says(spark, folder, tmp_path):
    source = folder(
        a=f"{HEAD}\n2024-01-01 00:00:00.5,DDoS,1.1.1.1,2.2.2.2,\"x, y\",\n2024-01-01 00:00:01,DoS,1.1.1.1,NaN,z,m\n",
        b=",".join(ALERTS.names[:-1]) + "\n2024-01-02 00:00:00,DoS,1.1.1.1,2.2.2.2,z\n",
        p=",".join(PACKETS.names[:-2]) + "\n2024-01-01 00:00:00,a,1,b,,TCP,60,0x0002\n",
        h=",".join(HOST_STATS.names) + "\n2024-01-01 00:00:00,2024-01-01 00:01:00,a,1,1,0,1,1,60\n",
        swapped="alert_type,ts,src_ip,dst_ip,details,model_name\nx,y,z,a,b,c\n",
        users="id,username,password,role\n1,a,b,c\n",
    )
    root = str(tmp_path / "out")
    assert loaded(csv.load_folder(spark, source, root)) == {
        "a.csv": ("alerts", "loaded", 2),
        "b.csv": ("alerts", "loaded", 1),
        "p.csv": ("packets", "loaded", 1),
        "h.csv": ("host_stats", "loaded", 1),
        "swapped.csv": (None, "skipped", 0),
        "users.csv": (None, "skipped", 0),
    }
    rows = tables.scan(spark, "alerts", root).orderBy("ts").collect()
    assert [(r.ts.microsecond, r.dst_ip, r.details, r.model_name) for r in rows] == [
        (500000, "2.2.2.2", "x, y", None), (0, None, "z", "m"), (0, "2.2.2.2", "z", None),
    ]
    assert tables.scan(spark, "packets", root).first().dst_port is None
    assert tables.scan(spark, "alerts", root, since=dt.datetime(2024, 1, 1, 0, 0, 1)).count() == 2


def test_a_file_goes_in_whole_or_not_at_all(spark, folder, tmp_path):
    line = "2024-01-01 00:00:00,DDoS,1.1.1.1,2.2.2.2,x,m\n"
    source = folder(
        good=f"{HEAD}\n{line}{line}", bad=f"{HEAD}\n{line}not a time,DDoS,1.1.1.1,2.2.2.2,x,m\n",
        empty=f"{HEAD}\n", garbled=b"\xff\xfe\x00\n1,2\n",
    )
    root = str(tmp_path / "out")
    assert loaded(csv.load_folder(spark, source, root)) == {
        "good.csv": ("alerts", "loaded", 2), "bad.csv": ("alerts", "rejected", 0),
        "empty.csv": ("alerts", "loaded", 0), "garbled.csv": (None, "unreadable", 0),
    }
    assert tables.scan(spark, "alerts", root).count() == 2


def test_values_that_data_frames_write(spark, folder, tmp_path):
    head = ",".join(PACKETS.names[:-2])
    line = "2024-01-01 00:00:00,a,{},b,80,TCP,60,0x0002\n"
    source = folder(**{
        "good one": f"{head}\n{line.format(1)}", "gaps": f"{head}\n" + "".join(map(line.format, ["NaN", "443.0", "", "NULL", "N/A", "7"])),
        "middle": f"{head}\n{line.format(1)}{line.format('oops')}", "half": f"{head}\n{line.format('443.5')}",
        "short": f"{head}\n2024-01-01 00:00:00,a,1,b\n", "plus+": f"{head}\n\n{line.format(2)}\n", "nothing": "",
    })
    root = str(tmp_path / "out")
    assert loaded(csv.load_folder(spark, source, root)) == {
        "good one.csv": ("packets", "loaded", 1), "gaps.csv": ("packets", "loaded", 6), "middle.csv": ("packets", "rejected", 0),
        "half.csv": ("packets", "rejected", 0), "short.csv": ("packets", "rejected", 0), "plus+.csv": ("packets", "loaded", 1),
    }
    ports = [r.src_port for r in tables.scan(spark, "packets", root).collect()]
    assert sorted(p or 0 for p in ports) == [0, 0, 0, 0, 1, 2, 7, 443]


def test_strict_reading_refuses_a_wrong_header(spark, folder):
    source = folder(u="type,url\nbenign,a.com\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv.labelled_urls(spark, f"{source}/u.csv").collect()


def test_numeric_columns_in_file_order(spark, folder):
    source = folder(n=",".join(BASELINE.names) + "\n1.1.1.1,100.5,10,NaN,2024-01-01 00:00:00\n")
    df = csv.numeric_baseline(spark, f"{source}/n.csv", BASELINE)
    assert df.columns == ["packet_rate", "unique_port_count", "avg_pkt_size"]
    assert tuple(df.first()) == (100.5, 10.0, None)


def test_burst_export_and_json(spark, at, tmp_path):
    scans = at([(0, "Port Scan", "a,b"), (1.5, "Port Scan", "a,b"), (2, "Port Scan", "a,b")], "alert_type string, src_ip string")
    bursts = A.scan_bursts(scans)
    exports.burst_csv(bursts, str(tmp_path / "csv"))
    text = [line.value for line in spark.read.text(str(tmp_path / "csv")).collect()]
    assert text == ["Source IP,Burst Start,Burst End,Scans in Burst",
                    '"a,b",2024-01-01 00:00:00.000000,2024-01-01 00:00:02.000000,3']
    rows = exports.json_rows(bursts.withColumn("none", F.lit(None).cast("string")).drop("burst_start", "burst_end"))
    assert [r.json for r in rows.collect()] == ['{"src_ip":"a,b","scans_in_burst":3,"none":null}']
    exports.write_json(bursts, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_day_folders_are_pruned(spark, at, tmp_path):
    rows = at([(86400 * d, "DoS", "a", "b", "x", "m") for d in range(5)], ", ".join(f"{n} string" for n in ALERTS.names[1:]))
    tables.insert_alerts(rows, str(tmp_path))
    df = tables.scan(spark, "alerts", str(tmp_path), since=at.start + dt.timedelta(days=3))
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts" in plan
