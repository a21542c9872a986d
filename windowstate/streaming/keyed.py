"""The keyed window operator on Spark's own state (U5): late rows, firing, seeding and retention by transformWithState.

`keyed_windows` counts rows per key and tumbling window. Its state is grouped by window and by a bucket of keys: a call
to the state costs the same for one count as for a thousand, and each group makes a few calls per micro-batch, not each
key. A group holds runs of counts (arrays of keys and of counts): a micro-batch appends one run, and when as many counts
were appended as the group held keys, the runs are summed into one. A window fires when the watermark passes its end: an
event-time timer per group emits the sums and clears the group. A late row opens its window again and fires it as a
delta in the same micro-batch, as nothing here is dropped: Spark filters late rows by the column that carries the
watermark, and in this stream only `tick` rows carry it. Every Arrow batch is counted before the shuffle into one row per
(window, key), with a null watermark column, plus one tick row with the batch's largest time; so a key with a third of
all rows sends a few rows per Arrow batch to its task.

The keys of one window and bucket are summed in one task's memory: `buckets` is to grow with the keys of a window, not
with the rows. It is fixed by a query's first start, as the state's keys are made of it.

State is checkpointed, restored and read back by Spark (`read_windows`); `initial` seeds it from a table (T9).
`retained_windows` keeps what has fired readable for the cleanup delay with the state's time-to-live (T7): entries that
have expired can not be read and are removed by the state store.

Both need the RocksDB state store; `rocksdb_state` sets it for the queries started inside it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from windowstate.functions.align import window_end
from windowstate.functions.timecols import ms_timestamp
from windowstate.session import ROCKSDB_PROVIDER

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PARTIAL_SCHEMA = "window_end_ms bigint, key bigint, n bigint, tick_ms bigint"
WINDOWS_SCHEMA = "window_end_ms bigint, key bigint, n bigint"
BUCKETS = 16                    # of the keys of a window
RUN = "keys array<bigint>, counts array<bigint>"
RUN_ROWS = 10_000               # counts of a run at most
MIN_SUMMED = 1_000              # appended counts from which runs are summed
COUNTS = "counts"               # state variable of the open windows: runs
SIZES = "sizes"                 # state variable: counts in the group's runs, and those that make it sum them
RETAINED = "retained"           # state variable of the fired ones


@contextmanager
def rocksdb_state(spark: SparkSession):
    """transformWithState runs on the RocksDB state store only; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_CONF)
        else:
            spark.conf.set(PROVIDER_CONF, before)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of an Arrow batch by window and key, and its tick."""
    schema = pa.schema([(c, pa.int64()) for c in ("window_end_ms", "key", "n", "tick_ms")])
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        counts = rows.group_by(["window_end_ms", "key"]).aggregate([([], "count_all")]).combine_chunks()
        last = max(x for x in rows["ts_ms"].to_pylist())
        columns = [[*counts[c].to_pylist(), tick] for c, tick in
                   (("window_end_ms", counts["window_end_ms"][0].as_py()), ("key", counts["key"][0].as_py()), ("count_all", 0))]
        ticks = [None] * counts.num_rows + [last]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, ticks)], schema=schema)


def partial_counts(keys: DataFrame, size_ms: int) -> DataFrame:
    """`(window_end_ms, key, n, tick_ms)` of a stream `(ts_ms, key)` (rows without time can't be placed and go): map-side
    counts per Arrow batch, and tick rows with n = 0."""
    rows = keys.where(F.col("ts_ms").isNotNull()).select(
        window_end("ts_ms", size_ms).alias("window_end_ms"), F.col("key").cast("bigint").alias("key"),
        F.col("ts_ms").cast("bigint").alias("ts_ms"))
    return rows.mapInArrow(_partial, PARTIAL_SCHEMA)


class WindowCounts(StatefulProcessor):
    """The counts of a window's keys of one bucket; a timer fires them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState(COUNTS, RUN)
        self.sizes = handle.getValueState(SIZES, "held bigint, sum_at bigint")

    def _put(self, sums: dict) -> list[tuple[list, list]]:
        keys, counts = list(sums), list(sums.values())
        return [(keys[i:i + RUN_ROWS], counts[i:i + RUN_ROWS]) for i in range(0, len(keys), RUN_ROWS)]

    def _sums(self) -> dict:
        sums: dict = {}
        for keys, counts in self.runs.get():
            for k, n in zip(keys, counts, strict=True):
                sums[k] = sums.get(k, 0) + n
        return sums

    def _add(self, end: int, sums: dict) -> None:
        sizes = self.sizes.get()
        if sizes is None:
            self.handle.registerTimer(end + 1)          # Spark fires at expiry <= watermark; the close is strict
        held, sum_at = sizes or (0, MIN_SUMMED)
        for run in self._put(sums):
            self.runs.appendValue(run)
        held += len(sums)
        if sizes is not None and held >= sum_at:
            whole = self._sums()
            self.runs.clear()
            for run in self._put(whole):
                self.runs.appendValue(run)
            held, sum_at = len(whole), max(MIN_SUMMED, 2 * len(whole))
        self.sizes.update((held, sum_at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sums: dict = {}
        for row in rows:
            if row.n:
                sums[row.key] = sums.get(row.key, 0) + row.n
        if sums:
            self._add(key[0], sums)
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._add(key[0], dict(zip(initialState.seed_keys, initialState.seed_counts, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sums = self._sums()
        self.runs.clear()
        self.sizes.clear()
        for k, n in sums.items():
            yield Row(window_end_ms=key[0], key=k, n=n)

    def close(self) -> None:
        pass


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def _seed(initial: DataFrame, buckets: int) -> DataFrame:
    """The open windows as a row per (window, bucket) with its keys and counts."""
    rows = initial.select(F.col("window_end_ms").cast("bigint").alias("window_end_ms"),
                          F.col("key").cast("bigint").alias("key"), F.col("n").cast("bigint").alias("n"))
    pairs = rows.groupBy("window_end_ms", _bucket(buckets)).agg(F.collect_list(F.struct("key", "n")).alias("p"))
    return pairs.select("window_end_ms", "bucket", F.col("p.key").alias("seed_keys"), F.col("p.n").alias("seed_counts"))


def keyed_windows(keys: DataFrame, size_ms: int, delay_ms: int = 0, initial: DataFrame | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """The stream of fires `(window_end_ms, key, n)` of a stream `(ts_ms, key)`; a window may fire again, with what came
    late. `initial` is a table of open windows `(window_end_ms, key, n)`, one row each, to start from."""
    rows = partial_counts(keys, size_ms).select("window_end_ms", _bucket(buckets), "key", "n",
                                                ms_timestamp(F.col("tick_ms")).alias("tick"))
    seed = None if initial is None else _seed(initial, buckets).groupBy("window_end_ms", "bucket")
    return rows.withWatermark("tick", f"{delay_ms} milliseconds").groupBy("window_end_ms", "bucket").transformWithState(
        WindowCounts(), WINDOWS_SCHEMA, "append", "eventTime", seed)


class RetainedWindows(StatefulProcessor):
    """Fired windows of a key, each readable for the delay after its last fire."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getMapState(RETAINED, "window_end_ms bigint", "n bigint", ttlDurationMs=self.delay_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self.fired.updateValue((row.window_end_ms,), (row.n,))     # a window that fires again is replaced (T6)
        for (end,), (n,) in self.fired.iterator():
            yield Row(window_end_ms=end, key=key[0], n=n)

    def close(self) -> None:
        pass


def retained_windows(fires: DataFrame, delay_ms: int) -> DataFrame:
    """The stream of what is readable for each key that fires: `(window_end_ms, key, n)`, from a stream of fires. The
    delay runs from a window's own last fire in processing time; the reference clears a partition at once, when
    nothing in it has fired for the delay. For repeated triggers: an availableNow run of a processing-time operator
    never ends, as each micro-batch asks for another."""
    return fires.groupBy("key").transformWithState(RetainedWindows(delay_ms), WINDOWS_SCHEMA, "update", "processingTime")


def read_windows(spark: SparkSession, checkpoint: str, variable: str = COUNTS, batch_id: int | None = None) -> DataFrame:
    """`(window_end_ms, key, n)` held by the operator's state after its last micro-batch or after `batch_id`."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(checkpoint)
    if variable == COUNTS:
        runs = state.select(F.col("key.window_end_ms").alias("window_end_ms"),
                            F.explode(F.arrays_zip("list_element.keys", "list_element.counts")).alias("c"))
        return (runs.groupBy("window_end_ms", F.col("c.keys").alias("key"))
                .agg(F.sum("c.counts").cast("bigint").alias("n")))
    value = F.col("user_map_value.value.n")             # state with a time-to-live wraps its value
    return state.select(F.col("user_map_key.window_end_ms").alias("window_end_ms"), F.col("key.key").alias("key"),
                        value.alias("n"))
