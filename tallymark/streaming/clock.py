"""Zone-less event times on streams.

A watermark needs an instant. Zone-less times are read as UTC, whatever the
session zone, so windows stay aligned with the wall clock of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def instant(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.col(column)
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(column)))


def utc_clock(c: Column) -> Column:
    """Wall clock of a whole-second instant, such as a window bound, in UTC."""
    zero = F.lit(0)
    return _epoch() + F.make_dt_interval(zero, zero, zero, F.unix_seconds(c))
