"""Tumbling-window alignment.

The window of a timestamp is aligned with *truncating* remainder: start = ts - ts % size, end = start + size.
For ts >= 0 this equals Spark's window(); for ts in (-size, 0) it yields [0, size), so the window around the
epoch is double width. Batch operators use this arithmetic for parity; streaming uses window() (ts >= 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_start(ts_ms: Column | str, size_ms: int) -> Column:
    ts = _c(ts_ms)
    return ts - ts % F.lit(size_ms).cast("bigint")


def window_end(ts_ms: Column | str, size_ms: int) -> Column:
    return window_start(ts_ms, size_ms) + F.lit(size_ms).cast("bigint")
