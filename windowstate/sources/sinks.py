"""Sinks: result pairs as text (S3), keys as text (S4), Kafka writers. Print sinks are writeStream.format('console')."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.functions.codec import long_text, pair_text


def pairs_frame(counts: DataFrame, key: str = "key", n: str = "n",
                encode: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """S3 payload: one `value` string '(key,count)' per emitted pair (the window id is dropped, as in the
    reference's output). `encode` (U3) is another Column function of key and count."""
    value = pair_text(key, n) if encode is None else encode(F.col(key), F.col(n))
    return counts.select(value.alias("value"))


def text_keys_frame(keys: DataFrame, key: str = "key") -> DataFrame:
    """S4 payload: one decimal `value` per key."""
    return keys.select(long_text(key).alias("value"))


def start_text_sink(frame: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """S3 / S4 on files: a stream of `value` strings appended to text files. The file sink writes each micro-batch once:
    its log of committed batches is what `read_text_sink` reads by, so a batch tried again or a restart adds nothing."""
    w = frame.select("value").writeStream.outputMode("append").format("text").option("path", path)
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_text_sink(spark, path: str) -> DataFrame:
    """The `value` strings of committed micro-batches."""
    return spark.read.schema("value string").text(path)


def kafka_sink(frame: DataFrame, brokers: str, topic: str, checkpoint: str | None = None):
    """Writer for a `value` frame to Kafka: batch writer for a static frame, stream writer (needs a checkpoint)
    for a streaming one. Needs the spark-sql-kafka connector."""
    if frame.isStreaming:
        return (frame.writeStream.format("kafka").option("kafka.bootstrap.servers", brokers)
                .option("topic", topic).option("checkpointLocation", checkpoint))
    return frame.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic)

