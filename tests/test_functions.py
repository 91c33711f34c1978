import ipaddress

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netsight.functions import derive
from netsight.sources import csv


def valid(text):
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


PIECES = ["", ":", "::", ".", "%", "0", "1", "255", "256", "01", "10", "f", "FFFF", "12345", "g", "1.2.3.4", " ", "\n", "2001:db8"]


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=9).map("".join), min_size=50, max_size=200))
def test_random_addresses(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    for r in df.select("ip", derive.is_ip(F.col("ip")).alias("ok")).collect():
        assert r.ok == valid(r.ip), repr(r.ip)


def test_known_addresses(spark):
    texts = [
        "10.0.0.1", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "", "abc", "::", "::1", "1::",
        "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7",
        "1::2::3", ":::", ":1", "1:", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
        "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1.2.3.4::", "::1.2.3.4:5", "12345::", "g::", "10.0.0.1%1", " ::1",
    ]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "ip string")
    got = {r.ip: r.ok for r in df.select("ip", derive.is_ip(F.col("ip")).alias("ok")).collect()}
    assert got == {**{t: valid(t) for t in texts}, None: False}


def test_full_url(spark):
    rows = [
        (True, "h", None, "/a", None, "http://h/a", "http://h/a"),
        (True, "h", "http://h/b", "/a", None, "http://h/b", "http://h/b"),
        (True, "h", "HTTP://h/b", "/a", None, "http://hHTTP://h/b", "HTTP://h/b"),
        (True, "h", "", "", None, "http://h", "http://h"),
        (True, None, "http://h/b", "/a", "s", None, None),
        (False, None, None, None, "s", "https://s", "https://s"),
        (None, None, None, None, "", None, None),
    ]
    df = spark.createDataFrame(rows, "http boolean, host string, full string, uri string, sni string, a string, b string")
    args = [F.col(c) for c in ("http", "host", "full", "uri", "sni")]
    got = df.select("a", "b", derive.full_url(*args).alias("x"), derive.full_url(*args, any_case=True).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(r.a, r.b) for r in got]


def test_dissected_fields(spark):
    rows = [
        ("TCP", "HTTP", "80", "0", "60", "0x0002"),
        ("UDP", None, None, "53", None, ""),
        (None, "ARP", "1", "2", "x", None),
        (None, None, "1", "2", "", None),
    ]
    cols = "transport_layer string, highest_layer string, src_port string, dst_port string, length string, tcp_flags string"
    raw = spark.createDataFrame(rows, cols).withColumns({
        "ts": F.expr("timestamp_ntz'2024-01-01'"), "src_ip": F.lit("1.1.1.1"), "dst_ip": F.lit("1.1.1.2"), "has_http": F.lit(False),
        **{c: F.lit(None).cast("string") for c in ("http_host", "http_full_uri", "http_uri", "tls_sni")},
    })
    got = derive.dissect(raw).select("protocol", "src_port", "dst_port", "pkt_len", "tcp_flags").collect()
    assert [tuple(r) for r in got] == [
        ("TCP", 80, 0, 60, "0x0002"), ("UDP", None, 53, 0, None), ("ARP", None, None, 0, None), ("UNKNOWN", None, None, 0, None),
    ]


def test_texts_and_numbers(spark):
    df = spark.createDataFrame([("SYN flood from x", "9 packets", -5.0, 3, 0), ("  ", "no packets", None, 1, 8), (None, None, 7.0, 9, 4)],
                               "m string, d string, v double, a int, b int")
    got = df.select(
        derive.alert_type_of(F.col("m")), derive.packet_count_of(F.col("d")), derive.at_least(F.col("v"), 0.0),
        derive.ratio(F.col("a"), F.col("b")), derive.ratio(F.col("a"), F.col("b"), digits=None, null_as_zero=False),
    ).collect()
    assert [tuple(r) for r in got] == [("SYN", 9, 0.0, 0.0, None), (None, None, None, 0.13, 0.125), (None, None, 7.0, 2.25, 2.25)]


def test_timestamps_from_text(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.678",), ("2024-01-02T03:04:05",), ("soon",), (None,)], "t string")
    got = [r.t and r.t.isoformat() for r in csv.coerce_timestamps(df, "t").collect()]
    assert got == ["2024-01-02T03:04:05.678000", "2024-01-02T03:04:05", None, None]
