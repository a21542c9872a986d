"""Timestamp <-> epoch-millisecond conversions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_div(c: Column, d: Column | int) -> Column:
    """SQL `div`: integral division truncating toward zero (Java semantics)."""
    d = d if isinstance(d, Column) else F.lit(d)
    return F.call_function("div", c.cast("bigint"), d.cast("bigint"))


def floor_div(c: Column, d: Column | int) -> Column:
    """Exact integral floor division by a positive divisor."""
    d = d if isinstance(d, Column) else F.lit(d)
    return int_div(c - F.pmod(c, d), d)


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds (bigint, floored) of a timestamp / timestamp_ntz / integral column.

    TIMESTAMP_NTZ is read as a UTC wall clock, so the result is the same under any session time zone (its fields
    are rebuilt as a UTC instant; a cast or timestampdiff would go through the session zone and shift by an hour
    inside a daylight-saving gap)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        c = f"`{name}`"
        micros = F.expr(f"unix_micros(make_timestamp(year({c}), month({c}), day({c}), hour({c}), minute({c}), "
                        f"date_part('SECOND', {c}), 'UTC'))")
    elif isinstance(dtype, T.TimestampType):
        micros = F.unix_micros(F.col(name))
    elif isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(name).cast("bigint")
    else:
        raise TypeError(f"column {name} has type {dtype.simpleString()}, expected a timestamp or integer ms")
    return floor_div(micros, 1000)


def ms_timestamp(ms: Column) -> Column:
    """A TIMESTAMP (an instant, independent of the session zone) from epoch ms; what withWatermark/window() need."""
    return F.timestamp_millis(ms)
