"""Key sources: decoding a text/bytes key stream (S1 + P1) and the generated key sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.functions.codec import INVALID_KEY, parse_long
from windowstate.functions.timecols import int_div


def decode_keys(df: DataFrame, value_col: str = "value", invalid: int | None = INVALID_KEY,
                time_col: str | None = None, drop_invalid: bool = False,
                decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """`value` (binary or string) -> `key bigint` with the strict decimal parse; unparsable -> `invalid`
    (-1 by default, counted like any key, as the reference does); drop_invalid=True (or invalid=None) drops those
    rows instead. `decode` (U3) is another Column function from the value to the key. Works on batch and streaming frames alike; with Kafka pass time_col='timestamp' to keep the
    record time."""
    if drop_invalid:
        invalid = None
    key = parse_long(F.col(value_col), invalid=invalid) if decode is None else decode(F.col(value_col))
    cols = [key.alias("key")] + ([F.col(time_col).alias("ts")] if time_col else [])
    out = df.select(*cols)
    return out if invalid is not None else out.filter(F.col("key").isNotNull())


def kafka_key_reader(spark: SparkSession, brokers: str, topic: str, starting: str = "latest", **options: str):
    """S1 reader: a Kafka topic from the latest offsets; offsets are tracked by the query checkpoint, not committed
    to Kafka."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers)
              .option("subscribe", topic).option("startingOffsets", starting))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader


def kafka_key_stream(spark: SparkSession, brokers: str, topic: str, starting: str = "latest",
                     **options: str) -> DataFrame:
    """`(key, ts)` from a Kafka topic of decimal keys (record timestamp as event time). Needs the
    spark-sql-kafka connector on the classpath."""
    return decode_keys(kafka_key_reader(spark, brokers, topic, starting, **options).load(), "value",
                       time_col="timestamp")


def _sequence_key(index, subtask, num_keys: int, parallelism: int):
    step = num_keys // parallelism  # 0 when num_keys < parallelism: every subtask starts at 0
    return ((subtask * F.lit(step) + index) % F.lit(num_keys)).cast("bigint")


def key_sequence(spark: SparkSession, num_keys: int, parallelism: int, steps: int,
                 num_slices: int | None = None) -> DataFrame:
    """S2 bounded: `parallelism` generators each emit `steps` keys; generator i starts at i*(num_keys div p) and
    counts up modulo num_keys. Columns (subtask int, idx bigint, key bigint); generated in parallel by range()."""
    if num_keys <= 0 or parallelism <= 0 or steps < 0:
        raise ValueError("num_keys and parallelism must be positive, steps non-negative")
    ids = spark.range(0, parallelism * steps, numPartitions=num_slices)
    subtask = int_div(F.col("id"), steps)
    idx = F.col("id") - subtask * F.lit(steps)
    return ids.select(subtask.cast("int").alias("subtask"), idx.alias("idx"),
                      _sequence_key(idx, subtask, num_keys, parallelism).alias("key"))


def sequence_keys(df: DataFrame, index_col: str, num_keys: int, parallelism: int) -> DataFrame:
    """S2 over rows: row number v (a column counting from 0) belongs to generator v % p at index v div p. Columns
    (subtask, idx, key), one row per row of `df`."""
    v = F.col(index_col)
    subtask = (v % F.lit(parallelism)).cast("int")
    idx = int_div(v, parallelism)
    return df.select(subtask.alias("subtask"), idx.alias("idx"), _sequence_key(idx, subtask, num_keys, parallelism).alias("key"))


def key_sequence_stream(spark: SparkSession, num_keys: int, parallelism: int, rows_per_second: int = 100,
                        micro_batch: bool = False) -> DataFrame:
    """S2 unbounded: the same sequence from the rate source; rate row v belongs to generator v % p at index
    v div p. `rows_per_second` replaces the reference's per-record sleep. Columns (ts, subtask, idx, key)."""
    if micro_batch:
        src = (spark.readStream.format("rate-micro-batch")
               .option("rowsPerBatch", str(rows_per_second)).load())
    else:
        src = spark.readStream.format("rate").option("rowsPerSecond", str(rows_per_second)).load()
    subtask = (F.col("value") % F.lit(parallelism)).cast("int")
    idx = int_div(F.col("value"), parallelism)
    return src.select(F.col("timestamp").alias("ts"), subtask.alias("subtask"), idx.alias("idx"),
                      _sequence_key(idx, subtask, num_keys, parallelism).alias("key"))
