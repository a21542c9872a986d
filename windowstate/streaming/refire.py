"""Streaming re-fire (T5 parity mode) with foreachBatch.

Built-in streaming aggregation drops late rows. The reference never drops them: a row for an emitted window opens
a fresh partial window that is emitted again (a delta) at the next watermark. This writer keeps that state in
tables under `state_dir`, so it is durable, resumable and readable:

  log/b=<id>/        (t_ms, wm_ms, first_end, last_end)   one row per batch, written last (the commit marker), with
                                              the span of windows that the batch added counts to
  deltas/b=<id>/     (window_end_ms, key, n)  the batch's rows counted per window and key, sorted by window
  fires/fire_b=<id>/ ([partition,] window_end_ms, key, n)   what batch <id> emitted

Per micro-batch: pre-aggregate the batch to (window, key, n) and write it as the batch's delta; watermark =
max(previous watermark, max ts - delay). Windows in [previous watermark, watermark) close now: the log names the
batches whose windows reach into that span, and only those deltas are read (row groups pruned by window statistics);
rows of this batch for windows below the previous watermark are late and fire as they are. Live state is the sum of
the deltas of windows at or above the watermark, computed when read. So a batch costs its own size plus the windows
it closes; open state is never rewritten. Everything a batch writes is a folder named by its id, so a batch replayed
after a failure changes nothing; its logged time is kept from the first try.

With a cleanup delay (T7) a batch then removes what nothing reads any more: deltas of windows that are all
closed, fires of before the last pause in firing longer than the delay (every partition's retained set is
cleared by such a pause), and log rows that neither a delta nor a fire needs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from windowstate.functions.align import window_end
from windowstate.functions.keyhash import key_partition
from windowstate.session import delete_folder

LIVE_SCHEMA = "window_end_ms bigint, key bigint, n bigint"
LOG_SCHEMA = "b bigint, t_ms bigint, wm_ms bigint, first_end bigint, last_end bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of per-batch folders; empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _log(spark: SparkSession, state_dir: str) -> DataFrame:
    return _read(spark, f"{state_dir.rstrip('/')}/log", LOG_SCHEMA)


def read_batches(spark: SparkSession, state_dir: str) -> DataFrame:
    """`(b, t_ms, wm_ms)` of committed batches."""
    return _log(spark, state_dir).select("b", "t_ms", "wm_ms")


def last_batch(spark: SparkSession, state_dir: str, below: int | None = None) -> tuple[int | None, int | None]:
    """(b, wm_ms) of the last committed batch (of those below an id)."""
    log = read_batches(spark, state_dir)
    if below is not None:
        log = log.filter(F.col("b") < below)
    last = log.agg(F.max("b").alias("b"), F.max("wm_ms").alias("wm")).first()
    return last["b"], last["wm"]


def _window_deltas(spark: SparkSession, state_dir: str, since: int | None, until: int | None, max_b: int) -> DataFrame:
    """Counts of batches <= max_b for windows that end in [since, until) (None: no bound), from the deltas of the batches
    whose windows reach into it."""
    def within(first, last):
        out = F.lit(True)
        if since is not None:
            out = out & (last >= since)
        return out if until is None else out & (first < until)

    named = _log(spark, state_dir).filter((F.col("b") <= max_b) & within(F.col("first_end"), F.col("last_end")))
    # ids of batches with open or closing windows; the batches of a window's life span, whatever the job's age
    batches = [r[0] for r in named.select("b").collect()]
    if not batches:
        return spark.createDataFrame([], LIVE_SCHEMA)
    deltas = _read(spark, f"{state_dir}/deltas", f"b bigint, {LIVE_SCHEMA}")
    end = F.col("window_end_ms")
    return deltas.filter(F.col("b").isin(batches)).filter(within(end, end)).select("window_end_ms", "key", "n")


class RefireWriter:
    """foreachBatch function: `query = stream.writeStream.foreachBatch(RefireWriter(...)).start()`.

    Input rows need `ts_ms bigint` and `key`. `clock(batch_id)` gives the processing time logged for the batch
    (default: wall clock); replays pass a deterministic one. Without `cleanup_delay_ms` the whole history is kept.
    `encode` is the sink's Column function of key and count (U3)."""

    def __init__(self, state_dir: str, size_ms: int, delay_ms: int = 0, n_partitions: int | None = None,
                 clock: Callable[[int], int] | None = None, sink_dir: str | None = None,
                 cleanup_delay_ms: int | None = None, encode=None, sink: Callable[[DataFrame, int], None] | None = None):
        self.state_dir = state_dir.rstrip("/")
        self.size_ms = size_ms
        self.delay_ms = delay_ms
        self.n_partitions = n_partitions
        self.clock = clock or (lambda _b: int(time.time() * 1000))
        self.sink_dir = sink_dir.rstrip("/") if sink_dir else None
        self.cleanup_delay_ms = cleanup_delay_ms
        self.encode = encode
        self.sink = sink
        self._seen: dict[int, tuple[int | None, int | None]] = {}    # next batch id -> last batch before it

    def _write_delta(self, counts: DataFrame, batch_id: int) -> None:
        # sorted by window inside each file, so a read for some windows skips other row groups
        (counts.select("window_end_ms", "key", "n").hint("rebalance").sortWithinPartitions("window_end_ms")
         .write.mode("overwrite").parquet(f"{self.state_dir}/deltas/b={batch_id}"))

    def _commit(self, spark: SparkSession, batch_id: int, t_ms: int, wm: int | None, first: int | None,
                last: int | None) -> None:
        path = f"{self.state_dir}/log/b={batch_id}"
        if not _exists(spark, f"{path}/_SUCCESS"):        # a batch tried again keeps its first time
            (spark.createDataFrame([(t_ms, wm, first, last)], LOG_SCHEMA.split(", ", 1)[1]).coalesce(1)
             .write.mode("overwrite").parquet(path))
        self._seen = {batch_id + 1: (batch_id, wm), batch_id: self._seen.get(batch_id, (None, None))}

    def _previous(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int | None]:
        """The log is read once after a start; later batches remember their predecessor."""
        if batch_id not in self._seen:
            self._seen[batch_id] = last_batch(spark, self.state_dir, batch_id)
        return self._seen[batch_id]

    def _fires_frame(self, fires: DataFrame) -> DataFrame:
        if self.n_partitions:
            return key_partition(fires, "key", self.n_partitions).select("partition", "window_end_ms", "key", "n")
        return fires.select("window_end_ms", "key", "n")

    def seed(self, live: DataFrame, watermark_ms: int | None, t_ms: int | None = None) -> None:
        """T9 from a table: start from given open windows `(window_end_ms, key, n)` and watermark, as batch -1
        (before the stream's first batch). Only for a fresh state folder."""
        spark = live.sparkSession
        self._write_delta(live.select("window_end_ms", F.col("key").cast("bigint"), F.col("n").cast("bigint")), -1)
        (self._fires_frame(spark.createDataFrame([], LIVE_SCHEMA)).write.mode("overwrite")
         .parquet(f"{self.state_dir}/fires/fire_b=-1"))
        first, last = live.agg(F.min("window_end_ms"), F.max("window_end_ms")).first()
        self._commit(spark, -1, self.clock(-1) if t_ms is None else t_ms, watermark_ms, first, last)

    def clean(self, spark: SparkSession, batch_id: int, wm: int | None, t_ms: int) -> None:
        """Drop state that nothing can read after this batch."""
        # a row per batch that is not cleaned yet; read before anything goes
        rows = _log(spark, self.state_dir).collect()
        ends = {r["b"]: r["last_end"] for r in rows if r["last_end"] is not None}
        closed = [b for b, e in ends.items() if wm is not None and e < wm and b < batch_id]
        logged = [r["b"] for r in rows]
        fires = _read(spark, f"{self.state_dir}/fires", "fire_b bigint, window_end_ms bigint")
        times = (fires.select(F.col("fire_b").alias("b")).distinct()
                 .join(read_batches(spark, self.state_dir), "b").select("b", "t_ms").collect())
        gone, after = [], t_ms
        for b, t in sorted(times, key=lambda r: -r["t_ms"]):     # as many as there are uncleaned fires
            if gone or after - t > self.cleanup_delay_ms:
                gone.append(b)
            after = t
        for b in closed:
            delete_folder(spark, f"{self.state_dir}/deltas/b={b}")
        for b in gone:
            delete_folder(spark, f"{self.state_dir}/fires/fire_b={b}")
        needed = ({b for b, _ in times} - set(gone)) | (ends.keys() - set(closed))
        for b in logged:
            if b < batch_id and b not in needed:       # also what a batch without rows has left
                for folder in (f"fires/fire_b={b}", f"deltas/b={b}", f"log/b={b}"):
                    delete_folder(spark, f"{self.state_dir}/{folder}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pre = (batch.select(window_end("ts_ms", self.size_ms).alias("window_end_ms"), F.col("key").cast("bigint"),
                            F.col("ts_ms"))
               .groupBy("window_end_ms", "key").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("mx"))
               .persist())
        max_ts, first, last = pre.agg(F.max("mx"), F.min("window_end_ms"), F.max("window_end_ms")).first()
        prev_b, prev_wm = self._previous(spark, batch_id)
        cands = [w for w in (prev_wm, None if max_ts is None else max_ts - self.delay_ms) if w is not None]
        wm = max(cands) if cands else None
        self._write_delta(pre, batch_id)
        e = F.col("window_end_ms")
        if wm is None:
            fires = spark.createDataFrame([], LIVE_SCHEMA)
        else:
            closing = (e < F.lit(wm)) if prev_wm is None else ((e >= F.lit(prev_wm)) & (e < F.lit(wm)))
            late = (e < F.lit(prev_wm)) if prev_wm is not None else F.lit(False)
            fires = pre.filter(closing | late).select("window_end_ms", "key", "n")
            if prev_b is not None and prev_wm != wm:
                fires = fires.unionByName(_window_deltas(spark, self.state_dir, prev_wm, wm, prev_b))
            fires = fires.groupBy("window_end_ms", "key").agg(F.sum("n").cast("bigint").alias("n"))
        fired_dir = f"{self.state_dir}/fires/fire_b={batch_id}"
        self._fires_frame(fires).hint("rebalance").write.mode("overwrite").parquet(fired_dir)
        emit(spark, fired_dir, batch_id, self.sink_dir, self.encode, self.sink)
        t_ms = self.clock(batch_id)
        self._commit(spark, batch_id, t_ms, wm, first, last)
        if self.cleanup_delay_ms is not None:
            self.clean(spark, batch_id, wm, t_ms)
        pre.unpersist()


def emit(spark: SparkSession, fired_dir: str, batch_id: int, sink_dir: str | None, encode=None,
         sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """S3: a batch's emitted pairs as `value` strings, to one text folder per batch and / or a sink function."""
    from windowstate.sources.sinks import pairs_frame
    if sink_dir or sink:
        pairs = pairs_frame(spark.read.parquet(fired_dir), encode=encode)
        if sink_dir:
            pairs.write.mode("overwrite").text(f"{sink_dir}/batch={batch_id}")
        if sink:
            sink(pairs, batch_id)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_fire_log(spark: SparkSession, state_dir: str, since_ms: int | None = None) -> DataFrame:
    """`(fire_b, [partition,] window_end_ms, key, n)` of committed batches (logged at `since_ms` or later)."""
    fires = spark.read.parquet(f"{state_dir}/fires").withColumn("fire_b", F.col("fire_b").cast("bigint"))
    committed = read_batches(spark, state_dir)
    if since_ms is not None:
        committed = committed.filter(F.col("t_ms") >= since_ms)
    fires = fires.join(committed.select(F.col("b").alias("fire_b")), "fire_b", "left_semi")
    cols = ["fire_b"] + (["partition"] if "partition" in fires.columns else []) + ["window_end_ms", "key", "n"]
    return fires.select(*cols)


def read_live(spark: SparkSession, state_dir: str, batch: int | None = None) -> DataFrame:
    """Open windows after `batch` (default: the last committed batch): deltas of committed batches <= batch for
    windows at or above that batch's watermark (never fired), summed."""
    state_dir = state_dir.rstrip("/")
    last_b, wm = last_batch(spark, state_dir, None if batch is None else batch + 1)
    if last_b is None:
        return spark.createDataFrame([], LIVE_SCHEMA)
    return (_window_deltas(spark, state_dir, wm, None, last_b)
            .groupBy("window_end_ms", "key").agg(F.sum("n").cast("bigint").alias("n")))


def read_retained(spark: SparkSession, state_dir: str, at_ms: int, delay_ms: int, batch: int | None = None) -> DataFrame:
    """T6/T7 over streaming state: emitted windows still readable at `at_ms` after `batch` (default: last
    committed). Needs a writer built with n_partitions."""
    from windowstate.operators.retention import retained_view
    if batch is None:
        batch = last_batch(spark, state_dir)[0]
    return retained_view(read_fire_log(spark, state_dir), read_batches(spark, state_dir), batch, at_ms, delay_ms)


class LookupWriter:
    """L2 on a stream: foreachBatch over a request stream `(req_id, ts_ms, key)`; each micro-batch is answered
    against the latest committed state of a RefireWriter folder (live first, then retained at the batch's time),
    and the answers `(req_id, key, window_end_ms, n, found)` are written to `out_dir/batch=<id>` (overwrite:
    idempotent on replay)."""

    def __init__(self, state_dir: str, out_dir: str, size_ms: int, cleanup_delay_ms: int,
                 clock: Callable[[int], int] | None = None, now_ms: int | None = None):
        self.state_dir, self.out_dir = state_dir.rstrip("/"), out_dir.rstrip("/")
        self.size_ms, self.delay_ms = size_ms, cleanup_delay_ms
        self.clock = clock or (lambda _b: int(time.time() * 1000))
        self.now_ms = now_ms

    def __call__(self, requests: DataFrame, batch_id: int) -> None:
        from windowstate.operators.lookups import lookup
        spark = requests.sparkSession
        at = self.clock(batch_id)
        last_b = last_batch(spark, self.state_dir)[0]        # one snapshot for both
        live = read_live(spark, self.state_dir, last_b)
        ret = read_retained(spark, self.state_dir, at, self.delay_ms, last_b)
        now = self.now_ms if self.now_ms is not None else at
        answers = lookup(requests, live, self.size_ms, retained=ret, now_ms=now)
        answers.write.mode("overwrite").parquet(f"{self.out_dir}/batch={batch_id}")
