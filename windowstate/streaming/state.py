"""Reading streaming state back as tables.

The built-in aggregate keeps one state row per (window, key); `statestore` reads the latest committed version,
or the version of a given batch id, as rows. This is the queryable live state of a checkpointed query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_count_state(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """`(window_end_ms, key, n)` held by the windowed count's state store (open windows), optionally as of
    `batch_id`."""
    r = spark.read.format("statestore")
    if batch_id is not None:
        r = r.option("batchId", batch_id)
    st = r.load(checkpoint)
    # the value is the aggregation buffer of count(): a struct with one field
    buf = st.schema["value"].dataType.fieldNames()[0]
    return st.select(F.unix_millis(F.col("key.window.end")).alias("window_end_ms"), F.col("key.key").alias("key"),
                     F.col("value").getField(buf).cast("bigint").alias("n"))


def read_count_changes(spark: SparkSession, checkpoint: str, first: int = 0, last: int | None = None) -> DataFrame:
    """`(batch_id, removed, window_end_ms, key, n)`: what micro-batches first..last (default: the latest) changed in the
    windowed count's state: counts they wrote, and windows they removed (n null). The state store's change feed."""
    r = spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", first)
    if last is not None:
        r = r.option("changeEndBatchId", last)
    ch = r.load(checkpoint)
    buf = ch.schema["value"].dataType.fieldNames()[0]
    return ch.select("batch_id", (F.col("change_type") == "delete").alias("removed"),
                     F.unix_millis(F.col("key.window.end")).alias("window_end_ms"), F.col("key.key").alias("key"),
                     F.col("value").getField(buf).cast("bigint").alias("n"))


def state_from_changes(changes: DataFrame) -> DataFrame:
    """`(window_end_ms, key, n)`: the state that a table of changes adds up to: each window's last change, unless that
    removed it. A micro-batch that writes a window and then closes it removes it."""
    last = F.max(F.struct("batch_id", "removed", "n")).alias("c")
    return (changes.groupBy("window_end_ms", "key").agg(last).where("not c.removed")
            .select("window_end_ms", "key", F.col("c.n").alias("n")))


def state_inventory(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Operators and state stores of a checkpoint (format 'state-metadata')."""
    return spark.read.format("state-metadata").load(checkpoint)
