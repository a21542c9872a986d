"""Built-in streaming windowed count (T1-T4, drop mode) and its query wiring.

Spark closes a window when `end <= watermark` and drops a row as late when its window's end <= the watermark of
the previous micro-batch. The reference closes on `end < watermark`; declaring the delay one millisecond larger
gives exactly that (a window whose end equals max time - delay stays open). Late rows are dropped here; the
re-fire semantics (late rows counted again as deltas) are in `refire.py`."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from windowstate.functions.timecols import ms_timestamp


def with_event_time(df: DataFrame, ts_ms: str = "ts_ms") -> DataFrame:
    """Add `ts` (TIMESTAMP) from epoch ms; withWatermark/window() need an instant type, not timestamp_ntz."""
    return df.withColumn("ts", ms_timestamp(F.col(ts_ms)))


def with_ingestion_time(df: DataFrame) -> DataFrame:
    """Stamp each record with the time it is processed (constant within a micro-batch)."""
    return df.withColumn("ts", F.current_timestamp())


def with_arrival_time(files: DataFrame) -> DataFrame:
    """T1 on a file stream: each record's arrival is the modification time of the file that brought it, taken from the
    source's metadata column; it stays the same when a batch is tried again or a query restarts."""
    return files.select("*", F.col("_metadata.file_modification_time").alias("ts"))


def windowed_count(keys: DataFrame, size_ms: int, delay_ms: int = 0, strict: bool = True,
                   ts: str = "ts", key: str = "key") -> DataFrame:
    """T2-T4 + A1 on a stream: `(window_end_ms, key, n)` emitted once per window in append mode when the watermark
    passes it; rows for already-emitted windows are dropped (counted in numRowsDroppedByWatermark)."""
    delay = delay_ms + 1 if strict else delay_ms
    return (keys.withWatermark(ts, f"{delay} milliseconds")
            .groupBy(F.window(ts, f"{size_ms} milliseconds"), F.col(key).alias("key"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_millis(F.col("window.end")).alias("window_end_ms"), "key", "n"))


# The watermark advances once per micro-batch; one trigger per second matches the reference's 1000 ms interval.
DEFAULT_TRIGGER = {"processingTime": "1 second"}
AVAILABLE_NOW = {"availableNow": True}


def start_count(counts: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Start the append-mode query. `checkpoint` (T8) holds offsets, watermark and state: restarting with the same
    checkpoint resumes (T9). Unbounded by default (S6) with DEFAULT_TRIGGER; pass {'availableNow': True} for a
    bounded run over what is available."""
    w = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if fmt in ("console", "memory"):
        w = w.format(fmt)  # S5 print sink / in-memory table
    else:
        w = w.format(fmt).option("path", sink_path)
    return w.trigger(**(trigger or DEFAULT_TRIGGER)).start()


class EmitLog:
    """foreachBatch sink for the built-in windowed count (append mode): writes each micro-batch's emitted windows
    to `state_dir/fires/fire_b=<id>` (with the key's routing partition) and writes `(t_ms)` to `state_dir/log/b=<id>`,
    the layout the re-fire readers use; so the retained windows of a built-in stream can be read
    (`refire.read_retained`) and looked up. Writes are keyed by batch id (idempotent on replay)."""

    def __init__(self, state_dir: str, n_partitions: int, clock=None, sink_dir: str | None = None, encode=None,
                 sink=None):
        import time as _time
        self.state_dir = state_dir.rstrip("/")
        self.n_partitions = n_partitions
        self.clock = clock or (lambda _b: int(_time.time() * 1000))
        self.sink_dir = sink_dir.rstrip("/") if sink_dir else None
        self.encode, self.sink = encode, sink

    def __call__(self, emitted: DataFrame, batch_id: int) -> None:
        from windowstate.functions.keyhash import key_partition
        from windowstate.streaming.refire import _exists, emit
        spark = emitted.sparkSession
        (key_partition(emitted.select("window_end_ms", "key", "n"), "key", self.n_partitions)
         .select("partition", "window_end_ms", "key", "n").hint("rebalance").write.mode("overwrite")
         .parquet(f"{self.state_dir}/fires/fire_b={batch_id}"))
        emit(spark, f"{self.state_dir}/fires/fire_b={batch_id}", batch_id, self.sink_dir, self.encode, self.sink)
        path = f"{self.state_dir}/log/b={batch_id}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            (spark.createDataFrame([(self.clock(batch_id), None)], "t_ms bigint, wm_ms bigint").coalesce(1)
             .write.mode("overwrite").parquet(path))


def observed(rows: DataFrame, ts_ms: str = "ts_ms", name: str = "arrivals") -> DataFrame:
    """The stream with metrics that its progress carries: rows and latest time of each micro-batch."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.max(ts_ms).alias("last_ms"))


class ProgressTable(StreamingQueryListener):
    """The progress of each completed micro-batch as a row of a table `(batch_id, rows, last_ms, late_groups,
    state_rows)` under `path`, one folder per query and batch. `rows` and `last_ms` are the metrics of `observed`;
    late_groups counts the (window, key) groups that the watermark dropped, state_rows what the state then holds."""

    SCHEMA = "batch_id bigint, rows bigint, last_ms bigint, late_groups bigint, state_rows bigint"

    def __init__(self, spark, path: str, name: str = "arrivals"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None:
            return
        row = (p.batchId, seen["rows"], seen["last_ms"], sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
               sum(s.numRowsTotal for s in p.stateOperators))
        (self.spark.createDataFrame([row], self.SCHEMA).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/query={p.id}/batch={p.batchId}"))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def read(self, query_id=None, until_batch: int | None = None, timeout_s: float = 60) -> DataFrame:
        """The table (of one query). Progress arrives after its batch: with `until_batch`, waits for that batch's row."""
        import time

        from pyspark.errors import AnalysisException
        folder = f"{self.path}/query={query_id}" if query_id else f"{self.path}/query=*"
        end = time.monotonic() + timeout_s
        while True:
            try:
                table = self.spark.read.schema(self.SCHEMA).parquet(f"{folder}/batch=*")
                if until_batch is None or table.where(F.col("batch_id") >= until_batch).limit(1).count():
                    return table
            except AnalysisException:
                if until_batch is None:
                    raise
            if time.monotonic() > end:
                raise TimeoutError(f"no progress of batch {until_batch}")
            time.sleep(0.1)


class ProgressLog(StreamingQueryListener):
    """Keeps the last `keep` batches' progress (batch id, rows, watermark, state rows, late rows dropped)."""

    def __init__(self, keep: int = 1000):
        self.events: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.events.append({
            "batch_id": p.batchId, "rows": p.numInputRows, "watermark": p.eventTime.get("watermark"),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        })

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

