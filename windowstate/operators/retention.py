"""Retention of emitted windows.

Per routing partition p, every fire puts its windows into the retained set (a re-fire of window e replaces that
window's whole map in p) and re-arms one cleanup timer at fire time + delay; when a timer fires and it is the most
recent one, the whole retained set of p is dropped. So at time T the retained set of p is the set of fires of the
last "session" of fire times (gap <= delay), provided T <= last fire + delay; per (p, window) the last fire wins.

Fire times are one row per (partition, fire batch): the session scan is a window partitioned by p over that
small table. The fire log itself is never grouped into one task: the last fire per (p, window) is a partial
aggregate joined back on (p, window, fire_b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def current_fires(flog: DataFrame, log: DataFrame, batch: int, at_ms: int, delay_ms: int,
                  retained_since: int | None = None) -> DataFrame:
    """`(partition, fire_b)`: fires whose windows are retained at time `at_ms`, after batch `batch`.
    `retained_since` (a restart time) reproduces the reference losing retained windows on restart: fires before
    it are ignored (ours keep them by default, since they come from the durable fire log).

    A fire starts a session iff no fire of its partition lies in [t - delay, t). With time buckets of width
    `delay`, that predecessor is either an earlier fire in the same bucket or the previous bucket's latest fire,
    so the scans are grouped by (partition, bucket) - bounded by delay / trigger interval, not by the number of
    batches - and the last session start per partition is a plain max aggregate."""
    fires = (flog.filter(F.col("fire_b") <= F.lit(batch)).select("partition", "fire_b").distinct()
             .join(log.select(F.col("b").alias("fire_b"), "t_ms"), "fire_b"))
    if retained_since is not None:
        fires = fires.filter(F.col("t_ms") >= F.lit(retained_since))
    width = max(int(delay_ms), 1)
    fires = fires.withColumn("__bucket", F.floor(F.col("t_ms") / F.lit(width)).cast("bigint"))
    in_bucket = Window.partitionBy("partition", "__bucket").orderBy("t_ms", "fire_b")
    fires = fires.withColumn("__prev_in", F.lag("t_ms").over(in_bucket))
    bucket_max = (fires.groupBy("partition", "__bucket").agg(F.max("t_ms").alias("__prev_bucket_max"))
                  .withColumn("__bucket", F.col("__bucket") + 1))
    fires = fires.join(bucket_max, ["partition", "__bucket"], "left")
    prev = F.coalesce(F.col("__prev_in"), F.col("__prev_bucket_max"))
    # a fire at the same time as another continues its session (gap 0); a gap of exactly `delay` also continues
    fires = fires.withColumn("__starts", prev.isNull() | (F.col("t_ms") - prev > F.lit(delay_ms)))
    per_p = fires.groupBy("partition").agg(
        F.max(F.when(F.col("__starts"), F.col("t_ms"))).alias("__start"), F.max("t_ms").alias("__last_t"))
    cur = fires.join(per_p, "partition")
    return cur.filter((F.col("t_ms") >= F.col("__start")) &
                      (F.lit(at_ms) <= F.col("__last_t") + F.lit(delay_ms))).select("partition", "fire_b")


def retained_view(flog: DataFrame, log: DataFrame, batch: int, at_ms: int, delay_ms: int,
                  retained_since: int | None = None) -> DataFrame:
    """`(partition, window_end_ms, key, n, fire_b)`: emitted counts still readable at `at_ms` after `batch`.
    `flog` is a fire log with a partition column (fire_log(..., n_partitions=n)); it is read three times, so
    pass a materialized one."""
    cur = current_fires(flog, log, batch, at_ms, delay_ms, retained_since)
    in_session = flog.join(cur, ["partition", "fire_b"])
    last = (in_session.groupBy("partition", "window_end_ms").agg(F.max("fire_b").alias("fire_b")))
    return (in_session.join(last, ["partition", "window_end_ms", "fire_b"])
            .select("partition", "window_end_ms", "key", "n", "fire_b"))
