"""A state table laid out for repeated lookups (A2): bucketed by what lookups join on, sorted by window.

The table is hashed once, when it is written. Lookups then shuffle their requests only, to the table's buckets, however
often it is read; a range of windows reads the row groups that hold it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.operators.lookups import lookup
from windowstate.session import scratch_dir

PAIR = ["window_end_ms", "key"]


def write_state_table(state: DataFrame, n_buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Write `(window_end_ms, key, n)` as a bucketed table; its name. Without `path` the files are in the session's
    shared scratch folder."""
    name = name or f"windowstate_{uuid.uuid4().hex[:12]}"
    path = path or scratch_dir(state.sparkSession, "state-table")
    (state.select(*PAIR, "n").repartition(n_buckets, *PAIR).write.bucketBy(n_buckets, *PAIR).sortBy(*PAIR)
     .option("path", path).mode("overwrite").saveAsTable(name))
    return name


def read_state_table(spark: SparkSession, name: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """The table, or its windows that end in [since_ms, until_ms]."""
    state, end = spark.table(name), F.col("window_end_ms")
    if since_ms is not None:
        state = state.where(end >= since_ms)
    return state if until_ms is None else state.where(end <= until_ms)


def lookup_table(requests: DataFrame, name: str, size_ms: int, since_ms: int | None = None, until_ms: int | None = None,
                 **options) -> DataFrame:
    """L2 against a bucketed state table; `options` are those of `lookup`."""
    return lookup(requests, read_state_table(requests.sparkSession, name, since_ms, until_ms), size_ms, **options)
