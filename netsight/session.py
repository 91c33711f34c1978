"""Session set-up and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the steps that are to be deleted together, see `passing_steps`.
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def build_session(app: str = "netsight", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` uses __ for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        # Sessions of a busy source merge inside each map task before they are shuffled.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only a session on the local master, as in tests, may go without that setting and gets a folder of
    its own; executors on other machines would not see such a folder, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="netsight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/netsight/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors.

    Unlike checkpoint(), which runs its plan twice, this is one job, and later plans know the size.
    """
    path = scratch_path(df.sparkSession, "step")
    if (passing := _steps.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this package's own, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Steps stored inside are deleted at the end: for work whose result is written before, as in a stream."""
    made: list[str] = []
    token = _steps.set(made)
    try:
        yield
    finally:
        _steps.reset(token)
        for path in made:
            delete(spark, path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application (spark-submit --py-files does the same)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="netsight-ship-")) / "netsight_package"
    zipped = shutil.make_archive(str(archive), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(zipped)
    _shipped.add(app)
