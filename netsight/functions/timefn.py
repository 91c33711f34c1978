"""Time helpers. Event times are TIMESTAMP_NTZ in UTC; look-backs hang on an explicit as_of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def ntz_literal(value: dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def latest(df: DataFrame, ts: str) -> dt.datetime:
    """Newest `ts` in the table, as a plain value.

    A literal bound reaches the parquet scan as a pushed filter; a scalar subquery would not.
    """
    return df.agg(F.max(ts)).first()[0]


def resolve_as_of(df: DataFrame, ts: str, as_of: dt.datetime | str | None) -> dt.datetime:
    if as_of is None:
        newest = latest(df, ts)
        return newest if newest is not None else dt.datetime(1970, 1, 1)
    return dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def since(df: DataFrame, ts: str, as_of: dt.datetime | str | None, back: dt.timedelta) -> DataFrame:
    """Rows with ts >= as_of - back."""
    return df.filter(F.col(ts) >= ntz_literal(resolve_as_of(df, ts, as_of) - back))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session time zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, col.cast("timestamp_ntz"))


def floor_div(value: Column, size: int) -> Column:
    """Whole division rounding down, exact for any bigint."""
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size)).cast("bigint")


def trunc(unit: str, ts: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def seconds_between(later: str, earlier: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later)) / F.lit(float(MICROS))
