"""Common parts of the streams: event time, per-batch tables, carried state.

Streams need TIMESTAMP event times for watermarks; tables hold TIMESTAMP_NTZ in UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampType

from netsight.session import cut_lineage, delete, passing_steps

BATCH = "batch_id"
DELAY = "10 seconds"

BatchWriter = Callable[[DataFrame, int], None]


def event_time(stream: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def to_ntz(df: DataFrame) -> DataFrame:
    """All TIMESTAMP columns as TIMESTAMP_NTZ."""
    return df.withColumns({
        f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, TimestampType)
    })


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """The batch's rows as one partition of the table: a replay overwrites, never doubles."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a table written batch by batch."""
    return spark.read.parquet(path).drop(BATCH)


def newest_rows(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Of a table of changed rows, the last version of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), BATCH).alias("row"))
        .select(*keys, "row.*")
    )


def compact(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int) -> None:
    """Fold the batches before this one, all of them committed, into the last of them.

    If this ends half way, older versions of rows remain, which `newest_rows` passes over.
    """
    past = spark.read.parquet(path).filter(F.col(BATCH) < batch_id)
    old = [r[0] for r in past.select(BATCH).distinct().orderBy(BATCH).collect()]
    rest = [c for c in past.columns if c not in (*keys, BATCH)]
    rows = past.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("row")).select(*keys, "row.*")
    if len(old) > 1:
        write_batch(cut_lineage(rows), path, old[-1])
        for number in old[:-1]:
            delete(spark, f"{path}/{BATCH}={number}")


class Carried:
    """A small table handed from one micro-batch to the next, one version per batch id.

    Version n is made from version n - 1 and batch n, so a replayed batch gives the same again. Versions
    older than that are deleted: when batch n runs, batch n - 1 has been committed.
    """

    def __init__(self, path: str):
        self.path = path

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """What the batch before left; nothing before the first. A lost version is an error."""
        return spark.read.parquet(f"{self.path}/{BATCH}={batch_id - 1}") if batch_id else None

    def store(self, state: DataFrame, batch_id: int) -> None:
        write_batch(state, self.path, batch_id)
        if batch_id > 1:
            delete(state.sparkSession, f"{self.path}/{BATCH}={batch_id - 2}")


def start(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", partition_by: str | None = None,
          available_now: bool = False) -> StreamingQuery:
    """Append-only Parquet sink with its own exactly-once log."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def start_batches(stream: DataFrame, write: BatchWriter, checkpoint: str, *, mode: str = "append",
                  every: str | None = None, available_now: bool = False) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        with passing_steps(batch.sparkSession):
            write(batch, batch_id)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()
