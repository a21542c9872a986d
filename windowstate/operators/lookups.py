"""State lookups as joins.

A request `(req_id, ts_ms, key)` is aligned to its window end (a request exactly at a window end reads the *next*
window, as in the reference) and answered from live state first, then retained state, else n = 0 and
found = false. Requests and state meet in plain equi-joins on (window, key): Spark broadcasts the smaller side when
its bytes allow it and otherwise shuffles, splitting hot pairs of the requests at run time. Planning runs no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.functions.align import window_end
from windowstate.functions.codec import answer_text
from windowstate.functions.keyhash import key_partition
from windowstate.operators.scale import col_or_lit


def align_requests(requests: DataFrame, size_ms: int, now_ms: Column | int | None = None) -> DataFrame:
    """L3 + P5: a request without time reads the window containing `now_ms`."""
    ts = F.col("ts_ms") if now_ms is None else F.coalesce(F.col("ts_ms"), col_or_lit(now_ms))
    return requests.withColumn("ts_ms", ts).withColumn("window_end_ms", window_end("ts_ms", size_ms))


def lookup(requests: DataFrame, live: DataFrame, size_ms: int, retained: DataFrame | None = None,
           now_ms: Column | int | None = None, with_text: bool = False) -> DataFrame:
    """`(req_id, key, window_end_ms, n, found[, answer])` for every request. `live` and `retained`
    hold one row per (window_end_ms, key), as every state table of this library does."""
    req = align_requests(requests, size_ms, now_ms)
    pair = ["window_end_ms", "key"]
    out = req.join(live.select(*pair, F.col("n").alias("__live")), pair, "left")
    if retained is not None:
        out = out.join(retained.select(*pair, F.col("n").alias("__ret")), pair, "left")
        n = F.coalesce(F.col("__live"), F.col("__ret"))
    else:
        n = F.col("__live")
    out = out.select("req_id", "key", "window_end_ms", F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
                     n.isNotNull().alias("found"))
    if with_text:
        out = out.withColumn("answer", answer_text("key", "n", "found"))
    return out


def state_view(live: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """The queryable state as one table `(window_end_ms, key, n, origin)`; live rows shadow retained ones."""
    lv = live.select("window_end_ms", "key", "n", F.lit("live").alias("origin"))
    if retained is None:
        return lv
    rt = (retained.select("window_end_ms", "key", "n")
          .join(live.select("window_end_ms", "key"), ["window_end_ms", "key"], "left_anti")
          .withColumn("origin", F.lit("retained")))
    return lv.unionByName(rt)


def partition_audit(state: DataFrame, stored_col: str, n_partitions: int) -> DataFrame:
    """L4: rows whose stored partition is not the routing partition of their key."""
    return (key_partition(state, "key", n_partitions, part_col="expected_partition")
            .filter(F.col(stored_col) != F.col("expected_partition")))
