"""Stored tables: append rows, scan them, and the optional JDBC connector."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from netsight.session import cut_lineage, delete
from netsight.sources.schemas import EVENT_TIME, TABLES

DAY, LOAD = "event_date", "load_id"
#: Beside the tables: one row per finished load, and one per file that a load has taken in.
LOADS, FILES, QUARANTINE = "loads", "load_files", "quarantine"
_LOADS = "load_id string, seq bigint, finished_at timestamp, table string, replaced array<date>"
_FILES = "path string, length bigint, modified timestamp, table string, status string, n_rows bigint, load_id string"
_QUARANTINE = "file string, table string, line bigint, reason string, record string, load_id string"


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows in the table's column order and types; columns the input lacks are NULL."""
    have = set(rows.columns)
    return rows.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )


# A load is written to folders of its own and shows once its row is there, so that one which dies half
# way shows nothing. Loads of one root are expected one after the other.


def new_load() -> str:
    return uuid.uuid4().hex


def stage(rows: DataFrame, table: str, root: str, load: str) -> None:
    """Write the rows of a load, one folder per day so that time filters prune whole folders.

    A rebalance by day gives each day files of even size: a hot day is split, small days are merged.
    """
    out = conform(rows, table).withColumn(DAY, F.to_date(EVENT_TIME[table]))
    out.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(f"{root}/{table}/{LOAD}={load}")


def finish(spark: SparkSession, root: str, load: str, table: str | None = None, replaced: Collection[dt.date] = ()) -> None:
    """Make a load show; of `table`, it stands in for what earlier loads hold of the `replaced` days.

    Its row is one file of one task, which Spark puts in place as a whole.
    """
    seq = (loads(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    row = spark.createDataFrame([(load, seq, dt.datetime.now(dt.UTC), table, sorted(replaced))], _LOADS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/{LOADS}")


def append(rows: DataFrame, table: str, root: str) -> None:
    """Append rows to root/table as a load."""
    load = new_load()
    stage(rows, table, root, load)
    finish(rows.sparkSession, root, load)


def insert_packets(rows: DataFrame, root: str) -> None:
    append(rows, "packets", root)


def insert_alerts(rows: DataFrame, root: str) -> None:
    append(rows, "alerts", root)


def insert_host_stats(rows: DataFrame, root: str) -> None:
    append(rows, "host_stats", root)


def merge_host_stats(rows: DataFrame, root: str) -> None:
    """Write host_stats rows in place of the stored ones with their host and interval start; others are added.

    Only the days that the rows touch are written anew, as a load that stands in for them: until it has
    finished, readers see the old days, and afterwards the new ones. Of several rows with one key, the one
    with most packets counts, as the later state of its counters; ties by the greatest of the other columns.
    Rows without a time are of no day and are added only.
    """
    spark, keys = rows.sparkSession, ["host_ip", "interval_start"]
    rows = cut_lineage(conform(rows, "host_stats"))
    values = [c for c in rows.columns if c not in keys]
    order = ["total_packets", *[c for c in values if c != "total_packets"]]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("v")).select(*keys, *[F.col("v")[c].alias(c) for c in values])
    best = cut_lineage(best)
    days = sorted(r[0] for r in best.select(F.to_date("interval_start").alias("day")).distinct().where("day is not null").collect())
    load = new_load()
    if exists(spark, f"{root}/host_stats"):
        old = scan(spark, "host_stats", root, days=days)
        same = [old[k].eqNullSafe(best[k]) for k in keys]
        best = best.unionByName(old.join(best.select(*keys), same, "left_anti").select(*best.columns))
    stage(best, "host_stats", root, load)
    finish(spark, root, load, "host_stats", days)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _side(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def loads(spark: SparkSession, root: str) -> DataFrame:
    """The finished loads, a row each: number, time, and the table and days that one stands in for."""
    return _side(spark, root, LOADS, _LOADS)


def loaded_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file that a finished load has looked at, with its length, time, status and number of rows."""
    return _side(spark, root, FILES, _FILES).join(loads(spark, root).select(LOAD), LOAD, "left_semi")


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """The malformed records of rejected files: file, table, line of the file, reason, text."""
    return _side(spark, root, QUARANTINE, _QUARANTINE).join(loads(spark, root).select(LOAD), LOAD, "left_semi")


def _visible(spark: SparkSession, rows: DataFrame, table: str, root: str) -> DataFrame:
    """Rows of finished loads, less those of days that a later load stands in for. Both lists are of loads."""
    done = loads(spark, root)
    rows = rows.join(done.select(LOAD, "seq"), LOAD)
    newer = done.where(F.col("table") == table).select(F.explode("replaced").alias("day"), F.col("seq").alias("by"))
    newer = newer.groupBy("day").agg(F.max("by").alias("by"))
    rows = rows.join(newer, F.col(DAY) == F.col("day"), "left")
    return rows.where(F.col("by").isNull() | (F.col("seq") >= F.col("by"))).drop("seq", "by", "day")


def scan(spark: SparkSession, table: str, root: str, since: dt.datetime | None = None, days: Collection[dt.date] | None = None) -> DataFrame:
    """The stored table; `since` skips day folders as well as row groups, `days` all other day folders."""
    schema = StructType([*TABLES[table].fields, StructField(LOAD, StringType()), StructField(DAY, DateType())])
    df = spark.read.schema(schema).parquet(f"{root}/{table}")
    if since is not None:
        df = df.filter((F.col(DAY) >= F.lit(since.date())) & (F.col(EVENT_TIME[table]) >= F.lit(since)))
    if days is not None:
        df = df.filter(F.col(DAY).isin(*days) if days else F.lit(False))
    return _visible(spark, df, table, root).select(*TABLES[table].names)


def clear_unfinished(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders of loads that have not finished; only while no load runs. Returns their ids."""
    done = {r[0] for r in loads(spark, root).select(LOAD).collect()}
    gone = set()
    for name in (*TABLES, FILES, QUARANTINE):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in files.listStatus(place) if files.exists(place) else ():
            key, _, load = entry.getPath().getName().partition("=")
            if key == LOAD and load not in done:
                delete(spark, entry.getPath().toString())
                gone.add(load)
    return sorted(gone)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table, read in parallel ranges of `partition_column`. Needs the driver's jar."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_jdbc(
    rows: DataFrame, url: str, table: str, *, connections: int = 16, options: Mapping[str, str] | None = None
) -> None:
    """Append rows to a database table over a bounded number of connections."""
    (
        rows.write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("numPartitions", connections)
        .option("batchsize", 10_000)
        .options(**(options or {}))
        .mode("append")
        .save()
    )
