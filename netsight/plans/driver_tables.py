"""The engine's input tables, derived row by row from the TPC-H-like test tables.

Integer arithmetic only, so that Spark here and the SQL in `oracle.py` see the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.operators import rollup
from netsight.session import cut_lineage, scratch_path

STATS_SECONDS = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ip(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def pick(number: Column, *values: str) -> Column:
    """values[number]; NULL past the end."""
    out = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(values))):
        out = F.when(number == i, F.lit(v)).otherwise(out)
    return out


def alerts_of(events: DataFrame) -> DataFrame:
    c = F.col
    event, target = c("event_id"), ip("192.168.1.", c("event_id") % 7)
    kind = F.when(c("event_type") == "click", "Port Scan").when(c("event_type") == "error", "DDoS")
    kind = kind.when(c("event_type") == "purchase", "DoS").when(c("event_type") == "signup", "SYN Flood")
    text = F.lit
    return events.select(
        event.alias("alert_id"),
        "ts",
        kind.otherwise("Anomalous").alias("alert_type"),
        ip("10.0.0.", c("user_id") % 40).alias("src_ip"),
        target.alias("dst_ip"),
        F.concat(
            (20 + event % 81).cast("string"), text(" sources, "),
            (1000 + event * 37 % 4001).cast("string"), text(" packets -> "), target,
            text(" in "), (5 + event % 16).cast("string"), text(" s"),
        ).alias("details"),
        pick(event % 3, "RandomForest", "DecisionTree", "LinearSVM").alias("model_name"),
    )


def packets_of(lineitem: DataFrame) -> DataFrame:
    order, line, part, supp = (F.col(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    offset = (order * 61 + line * 17) % 259200
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return lineitem.select(
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset)).alias("ts"),
        ip("10.0.0.", supp % 20).alias("src_ip"),
        (1024 + (part * 31 + order) % 64512).cast("int").alias("src_port"),
        ip("10.0.0.", (supp + 1 + part % 19) % 20).alias("dst_ip"),
        F.when((order + line) % 4 == 0, 80)
        .when((order + line) % 4 == 1, 443)
        .when((order + line) % 4 == 2, 8080)
        .otherwise((1024 + part * 17 % 500).cast("int"))
        .alias("dst_port"),
        pick((order + line * 3) % 6, "TCP", "UDP", "TLS", "HTTP", "HTTPS", "RDP").alias("protocol"),
        (40 + (order * 13 + part * 7) % 1461).cast("int").alias("pkt_len"),
        pick((order + line) % 4, "0x0018", "0x0010", "0x0002", "0x0011").alias("tcp_flags"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(table(spark, sf_dir, "events"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(table(spark, sf_dir, "lineitem"))


def host_stats(spark: SparkSession, sf_dir: str, seconds: int = STATS_SECONDS) -> DataFrame:
    return rollup.host_stats(packets(spark, sf_dir), seconds=seconds)


def host_totals(spark: SparkSession, sf_dir: str, seconds: int = STATS_SECONDS) -> DataFrame:
    """host_stats without its distinct counts, for the questions that need none."""
    return rollup.host_totals(packets(spark, sf_dir), seconds=seconds)


def stats_as_of(spark: SparkSession, sf_dir: str, seconds: int = STATS_SECONDS) -> dt.datetime:
    """End of the newest host_stats interval, from the packets' times alone."""
    newest = packets(spark, sf_dir).agg(F.max(F.window("ts", f"{seconds} seconds")["end"])).first()[0]
    return newest


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 10
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.when(kind <= 6, "benign").when(kind <= 8, "phishing").otherwise("defacement").alias("type"),
    )


def learnable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a label that their text decides, so that a classifier has something to find."""
    kind = F.when(F.col("url").startswith("https:"), "benign").otherwise("phishing")
    return table(spark, sf_dir, "pages").select("page_id", "url", kind.alias("type"))


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") < 0)
        .select(ip("10.0.0.", F.col("s_suppkey") % 20).alias("ip_address"))
        .distinct()
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary score table: truth and score of each labelled document."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", "toxic", (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("score")
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predicted class of each labelled document, with one score per class."""
    doc = F.col("doc_id")
    truth = F.col("quality") + F.col("toxic") * 2
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        pick(truth, "benign", "defacement", "phishing", "phishing").alias("label"),
        pick(F.when(doc % 5 < 3, truth).otherwise(doc % 3), "benign", "defacement", "phishing", "phishing").alias("prediction"),
        F.create_map(
            F.lit("benign"), doc * 37 % 101 / F.lit(100.0),
            F.lit("defacement"), doc * 53 % 103 / F.lit(100.0),
            F.lit("phishing"), doc * 71 % 107 / F.lit(100.0),
        ).alias("scores"),
    )


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_packets_of(table(spark, sf_dir, "lineitem"))


def raw_packets_of(lineitem: DataFrame) -> DataFrame:
    """Dissected packet fields as text, with the gaps and oddities of a capture: from lineitem."""
    order, line, part, supp = (F.col(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    n = order * 7 + line * 3 + part
    host = F.concat(F.lit("h"), (supp % 50).cast("string"), F.lit(".example.com"))
    path = F.concat(F.lit("/p/"), (part % 100).cast("string"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return lineitem.select(
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (order * 61 + line * 17) % 259200)).alias("ts"),
        pick(n % 4, "TCP", "UDP").alias("transport_layer"),
        pick(n % 5, "TLS", "HTTP", "ARP", "ICMP").alias("highest_layer"),
        F.when(n % 11 == 0, F.lit(None))
        .when(n % 11 == 1, F.concat(F.lit("2001:db8::"), F.hex(part % 65536)))
        .otherwise(F.concat_ws(".", F.lit("10"), supp % 300, part % 260, line))
        .alias("src_ip"),
        F.when(n % 13 == 0, "").otherwise(ip("10.0.0.", supp % 20)).alias("dst_ip"),
        F.when(n % 6 != 0, (1024 + part % 100).cast("string")).alias("src_port"),
        F.when(n % 7 != 0, (part % 3 * 443).cast("string")).alias("dst_port"),
        F.when(n % 9 != 0, (40 + part % 1400).cast("string")).alias("length"),
        pick(n % 4, "0x0018", "0x0002").alias("tcp_flags"),
        (n % 3 == 0).alias("has_http"),
        F.when(n % 8 != 0, host).alias("http_host"),
        F.when(n % 10 == 0, F.concat(F.lit("http://"), host, path))
        .when(n % 10 == 3, F.concat(F.lit("HTTPS://"), host, path))
        .alias("http_full_uri"),
        F.when(n % 5 < 3, path).alias("http_uri"),
        F.when(n % 3 == 1, host).alias("tls_sni"),
    )


def url_packets_of(pages: DataFrame) -> DataFrame:
    """One web packet per page; every tenth carries no URL."""
    page = F.col("page_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return pages.select(
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), page * 37 % 86400)).alias("ts"),
        ip("10.0.0.", page % 20).alias("src_ip"),
        ip("10.0.1.", page % 7).alias("dst_ip"),
        pick(page % 4, "0x0018", "0x0010", "0x0002", "0x0011").alias("tcp_flags"),
        (40 + page * 13 % 1461).cast("int").alias("pkt_len"),
        F.when(page % 10 != 9, F.col("url")).alias("full_url"),
    )


def url_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_packets_of(table(spark, sf_dir, "pages"))


#: What stands for time in the tables that are streamed, as a whole number of seconds.
_TIME = {
    "events": "unix_seconds(timestamp(ts))",
    "lineitem": "(l_orderkey * 61 + l_linenumber * 17) % 259200",
    "pages": "page_id * 37 % 86400",
}


def stream(spark: SparkSession, sf_dir: str, name: str, *, parts: int = 4) -> DataFrame:
    """A test table as a stream of files, one after the other in time, one micro-batch each."""
    return stream_of(table(spark, sf_dir, name), F.expr(_TIME[name]), name, parts=parts)


def stream_of(rows: DataFrame, at: Column, name: str, *, parts: int = 4) -> DataFrame:
    """Rows as such a stream, by a whole number of seconds.

    A part has as many files as the rows have partitions, and a micro-batch takes just as many, so that no task
    writes or reads a whole part; a part of fewer rows gets empty files.
    """
    spark = rows.sparkSession
    first, last = rows.agg(F.min(at), F.max(at)).first()
    path, width = scratch_path(spark, f"stream-{name}"), (last - first) // parts + 1
    files = rows.rdd.getNumPartitions()
    for part in range(parts):
        inside = rows.filter((at >= first + part * width) & (at < first + (part + 1) * width))
        dealt = inside.repartition(files) if files > 1 else inside.coalesce(1)
        dealt.write.mode("append").parquet(path)
        written = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        for _ in range(written, (part + 1) * files):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    taken = {"maxFilesPerTrigger": files, "maxCachedFiles": parts * files}
    return spark.readStream.schema(rows.schema).options(**taken).parquet(path)


def stats_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """host_stats as a stream of files, by the end of the interval."""
    rows = cut_lineage(host_stats(spark, sf_dir))
    return stream_of(rows, F.expr("unix_seconds(timestamp(interval_end))"), name)
