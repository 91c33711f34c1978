"""What the text operators share: reading tables, word patterns, column checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space and the control characters from tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def as_bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text as UTF-8 bytes; null as empty), for functions over Arrow batches."""
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """One row after the other: only one text at a time becomes a Python object."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_mark(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with a column that names a document by its key and its text's hash, and that column's name.

    Decisions that depend on key and text alone are joined back by it; a key that occurs with several
    texts, or is null, is no trouble, and the texts need not be stored a second time.
    """
    (mark,) = fresh(docs, "_mark")
    # Null keys come last in the order of marks.
    named = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text"))
    return docs.withColumn(mark, named), mark


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key in turn, of batches that are sorted by the keys; one key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        marks = np.zeros(batch.num_rows, bool)
        for column in columns:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            marks[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(marks).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a].as_py() for c in columns)
            if held and key != last:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
