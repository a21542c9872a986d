"""Tumbling counts and the close/emit split.

The count is a plain groupBy: Spark plans a partial (map-side) count, a hash exchange on (window_end, key) and
a final count, so a hot key costs one partial row per map task, not one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.functions.align import window_end
from windowstate.functions.codec import pair_text
from windowstate.operators.scale import col_or_lit


def tumbling_count(rows: DataFrame, size_ms: int, key: str | Column = "key", ts: str = "ts_ms") -> DataFrame:
    """A1: `(window_end_ms, key, n)` = number of rows per key per tumbling window of `size_ms`. `key` is a column
    name or any Column expression (U2)."""
    k = F.col(key) if isinstance(key, str) else key
    return (rows.select(window_end(ts, size_ms).alias("window_end_ms"), k.alias("key"))
            .groupBy("window_end_ms", "key").agg(F.count(F.lit(1)).alias("n")))


def by_key_partitioning(rows: DataFrame, n_partitions: int, key: str = "key") -> DataFrame:
    """A2 made explicit: hash-partition rows by key (only useful when several keyed operators reuse it)."""
    return rows.repartition(n_partitions, key)


def closed_windows(counts: DataFrame, watermark: Column | int) -> DataFrame:
    """T4: windows emitted by a watermark: strictly `window_end < watermark` (end == watermark stays open)."""
    return counts.filter(F.col("window_end_ms") < col_or_lit(watermark))


def open_windows(counts: DataFrame, watermark: Column | int) -> DataFrame:
    """T4 complement: windows still live at a watermark."""
    return counts.filter(F.col("window_end_ms") >= col_or_lit(watermark))


def with_closed_flag(counts: DataFrame, watermark: Column | int) -> DataFrame:
    return counts.withColumn("closed", F.col("window_end_ms") < col_or_lit(watermark))


def emitted_pairs(closed: DataFrame) -> DataFrame:
    """P3 on emitted windows: keep the window id and add the '(key,count)' text the reference writes."""
    return closed.withColumn("pair", pair_text("key", "n"))


def state_size(live: DataFrame) -> DataFrame:
    """A3: number of keys per live window."""
    return live.groupBy("window_end_ms").agg(F.count(F.lit(1)).alias("num_keys"))


def max_time(rows: DataFrame, ts: str = "ts_ms") -> Column:
    """Scalar subquery: the largest timestamp (the watermark of an ingestion run that has seen everything)."""
    return rows.select(F.max(ts)).scalar()
