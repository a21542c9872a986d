"""Reading keyed, timed rows from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.functions.timecols import epoch_ms, int_div


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def timed_keys(df: DataFrame, key: str | Column, time: str, extra: list[str] | None = None) -> DataFrame:
    """Project a table to `(ts_ms bigint, key)` (+ extra columns). `time` is a timestamp, timestamp_ntz or
    epoch-ms column; only the needed columns survive, so the scan reads just those."""
    k = F.col(key) if isinstance(key, str) else key
    return df.select(*(extra or []), epoch_ms(df, time).alias("ts_ms"), k.alias("key"))


# ---- fixed values: out-of-order arrival used by the replay queries (arrival = id + (id*7919) % 500) ----
SHUFFLE_MULT = 7919
SHUFFLE_SPAN = 500
ARRIVAL_BATCHES = 10
# ----------------------------------------------------------------------------------------------------------


def arrival_rows(df: DataFrame, key: str, time: str, order: str, batches: int = ARRIVAL_BATCHES,
                 shuffled: bool = True) -> DataFrame:
    """Replay table `(b, ts_ms, key)`: rows arrive in order of `order` (optionally displaced by up to
    SHUFFLE_SPAN positions, which makes some rows late), in `batches` arrival batches of equal spans of positions
    whatever the table's size."""
    o = F.col(order).cast("bigint")
    arrival = o + (o * F.lit(SHUFFLE_MULT)) % F.lit(SHUFFLE_SPAN) if shuffled else o
    last = df.select(F.max(arrival)).first()[0] or 0
    batch_rows = last // batches + 1
    return df.select(int_div(arrival, batch_rows).alias("b"), epoch_ms(df, time).alias("ts_ms"),
                     F.col(key).alias("key"))
