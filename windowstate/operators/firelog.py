"""Late re-fire as set operations over a replay (T5, fire log; live state at a batch).

Input: `rows(b, ts_ms, key)` with arrival batch b. Each batch is followed by a watermark
wm(b) = running max over batches <= b of (max ts - delay) (non-decreasing). A window e fires at the first batch
whose watermark passes it; a row that arrives after its window already fired re-opens a fresh partial window,
which fires at the end of its own batch (a delta, never dropped):

    first_b(e) = min b with wm(b) > e,   fire_b = greatest(b, first_b(e)),   null first_b => still live.

Plan: the input is read once, for the pre-aggregate (b, e, key, n), which is written to the shared scratch folder. The
batch log (one row per batch) and the window ends (one row per window) are narrow aggregates of it; how many there are
is estimated by one pass over two of its columns, as only the number of chunks of the scans depends on it. first_b is an
as-of scan over those two tables (chunked, nothing paired) and joins the pre-aggregate on e, a plain equi-join whose
strategy Spark picks by bytes. Nothing is cached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.functions.align import window_end
from windowstate.functions.keyhash import key_partition
from windowstate.operators.scale import col_or_lit, first_mark_after, materialize, running_max, write_table


@dataclass
class Replay:
    pre: DataFrame    # (b, window_end_ms, key, n), materialized
    log: DataFrame    # (b, t_ms, wm_ms), one row per batch, materialized
    fired: DataFrame  # (b, window_end_ms, key, n, first_b, fire_b)


def pre_aggregate(rows: DataFrame, size_ms: int) -> DataFrame:
    """`(b, window_end_ms, key, n, last_ms)`: rows counted per arrival batch, window and key, with their latest time."""
    return (rows.select("b", window_end("ts_ms", size_ms).alias("window_end_ms"), "key", "ts_ms")
            .groupBy("b", "window_end_ms", "key").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms")))


def batch_log(rows: DataFrame, delay_ms: int = 0, t_ms: Column | None = None, n_batches: int | None = None) -> DataFrame:
    """`(b, t_ms, wm_ms)` of rows `(b, ts_ms)`: one row per arrival batch. `t_ms` is the processing time of the
    batch as an expression of b (default 1000*b); the watermark is the running max of (max ts - delay). With an
    estimate of the number of batches `rows` is aggregated where it is needed, else once into a table."""
    t = t_ms if t_ms is not None else F.col("b") * F.lit(1000)
    per = (rows.groupBy("b").agg((F.max("ts_ms") - F.lit(delay_ms)).alias("__mx"))
           .withColumn("t_ms", t.cast("bigint")))
    if n_batches is None:
        per, n_batches = materialize(per, "batches")
    log = running_max(per, "b", "__mx", "wm_ms", n_rows=n_batches).select("b", "t_ms", "wm_ms")
    return write_table(log, "log")


def first_fire(ends: DataFrame, log: DataFrame, n_rows: int | None = None) -> DataFrame:
    """`(window_end_ms, first_b)` for window ends `(window_end_ms)`: first batch whose watermark is strictly past
    each (null: open). `n_rows` estimates how many ends and batches there are."""
    ends = ends.select("window_end_ms").distinct()
    if n_rows is None:
        ends, n_ends = materialize(ends, "ends")
        n_rows = n_ends + log.count()
    return first_mark_after(ends, "window_end_ms", log, "wm_ms", "b", "first_b", strict=True, n_rows=n_rows)


def replay(rows: DataFrame, size_ms: int, delay_ms: int = 0, t_ms: Column | None = None) -> Replay:
    """Build the replay state of `rows(b, ts_ms, key)` for tumbling windows of `size_ms`."""
    pre = write_table(pre_aggregate(rows, size_ms), "pre")
    n_batches, n_ends = pre.agg(F.approx_count_distinct("b"), F.approx_count_distinct("window_end_ms")).first()
    log = batch_log(pre.select("b", F.col("last_ms").alias("ts_ms")), delay_ms, t_ms, n_batches)
    fe = write_table(first_fire(pre, log, n_batches + n_ends), "first")      # a row per window, read by every use
    fired = (pre.drop("last_ms").join(fe, "window_end_ms", "left")
             .withColumn("fire_b", F.when(F.col("first_b").isNotNull(), F.greatest(F.col("b"), F.col("first_b")))))
    return Replay(pre.drop("last_ms"), log, fired)


def fire_log(fired: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """T5: `(fire_b, [partition,] window_end_ms, key, n)`: what each watermark emitted; a late re-fire is a
    separate row (a delta) at its own fire batch. With n_partitions, add the routing partition of the key."""
    log = (fired.filter(F.col("first_b").isNotNull())
           .groupBy("fire_b", "window_end_ms", "key").agg(F.sum("n").cast("bigint").alias("n")))
    if n_partitions:
        log = key_partition(log, "key", n_partitions)
        return log.select("fire_b", "partition", "window_end_ms", "key", "n")
    return log


def live_at(fired: DataFrame, batch: int | Column) -> DataFrame:
    """`(window_end_ms, key, n)`: live (not yet emitted) state after batch `batch` has been processed."""
    b = col_or_lit(batch)
    return (fired.filter((F.col("b") <= b) & (F.col("first_b").isNull() | (F.col("fire_b") > b)))
            .groupBy("window_end_ms", "key").agg(F.sum("n").cast("bigint").alias("n")))


def watermark_at(log: DataFrame, batch: int) -> Column:
    """Scalar subquery: watermark after `batch`."""
    return log.filter(F.col("b") <= F.lit(batch)).select(F.max("wm_ms")).scalar()
