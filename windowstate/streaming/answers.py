"""L2 on a stream: requests joined with a state table in one streaming plan.

A stream-static join: each micro-batch of requests meets the table as an equi-join on (window, key); nothing is held in
state, and the file sink commits each micro-batch once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from windowstate.operators.lookups import lookup


def start_answers(requests: DataFrame, state: DataFrame, size_ms: int, path: str, checkpoint: str,
                  now_ms: Column | int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Answers `(req_id, key, window_end_ms, n, found)` of a request stream `(req_id, ts_ms, key)` against `state`
    `(window_end_ms, key, n)`, which is a table: `state_view`, a bucketed state table, or state read from a
    checkpoint. Appended to Parquet files under `path`."""
    return (lookup(requests, state, size_ms, now_ms=now_ms).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())
