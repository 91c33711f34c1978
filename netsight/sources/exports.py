"""Result sinks: CSV and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header line of the burst export.
BURST_HEADER = ("Source IP", "Burst Start", "Burst End", "Scans in Burst")

# The default format would cut microseconds.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def burst_csv(bursts: DataFrame, path: str) -> None:
    """Scan bursts as CSV with the export's header; values are quoted where needed."""
    rows = bursts.select("src_ip", "burst_start", "burst_end", "scans_in_burst").toDF(*BURST_HEADER)
    write_csv(rows, path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; a quote inside quotes is doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("timestampNTZFormat", TIME_FORMAT).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, NULL fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
