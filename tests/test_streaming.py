"""Structured Streaming: strict close, drop mode = batch formula, resume, state reads, re-fire writer, listener."""

import time

import pytest
from pyspark.sql import functions as F

from windowstate.operators import firelog
from windowstate.streaming import filereplay, refire
from windowstate.streaming.state import read_count_state, state_inventory
from windowstate.streaming.windowed import (AVAILABLE_NOW, ProgressLog, start_count, windowed_count, with_event_time,
                                            with_ingestion_time)

SCHEMA = "ts_ms bigint, key bigint"
ROWS = [(0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 12, 3), (2, 4, 1), (2, 9, 4), (3, 25, 3), (3, 19, 5), (4, 31, 1), (4, 5, 9)]
BATCHES = 5


def _rows(spark):
    return spark.createDataFrame(ROWS, "b long, ts_ms long, key long")


def _count_run(spark, tag, split=None, size=10):
    def start(src, r):
        return start_count(windowed_count(with_event_time(src), size), r.output, r.checkpoint, trigger=AVAILABLE_NOW)

    return filereplay.replay(spark, _rows(spark), filereplay.new_run(spark, tag, SCHEMA), start, BATCHES, split)


def _expected_drop(spark, size=10, split=None):
    """A window is emitted by the batch after the one whose watermark passes it, with that batch's rows (not after
    the split, where a no-data batch came first)."""
    f = firelog.replay(_rows(spark), size).fired
    until = F.col("first_b") + F.when(F.col("first_b") == (-1 if split is None else split), 0).otherwise(1)
    emitted = (f.filter(F.col("first_b").isNotNull() & (F.col("b") <= until))
               .groupBy("window_end_ms", "key").agg(F.sum("n").alias("n")))
    live = f.filter(F.col("first_b").isNull()).groupBy("window_end_ms", "key").agg(F.sum("n").alias("n"))
    return {tuple(r) for r in emitted.collect()}, {tuple(r) for r in live.collect()}


def test_stream_drop_mode_equals_batch_formula(spark):
    run = _count_run(spark, "t-drop")
    got = {tuple(r) for r in spark.read.parquet(run.output).select("window_end_ms", "key", "n").collect()}
    emitted, live = _expected_drop(spark)
    assert got == emitted
    # the late row of batch 4 (ts 5, window 10 passed by batch 1's watermark) is dropped, that of batch 2 is not
    assert (10, 1, 3) in got and not any(k == 9 for _, k, _ in got)
    assert {tuple(r) for r in read_count_state(spark, run.checkpoint).collect()} == live
    assert state_inventory(spark, run.checkpoint).count() >= 1


def test_state_history_by_batch(spark):
    run = _count_run(spark, "t-hist")
    # batch 1 runs with the watermark after batch 0 (3): nothing is closed yet
    st = read_count_state(spark, run.checkpoint, batch_id=1)
    assert {tuple(r) for r in st.collect()} == {(10, 1, 2), (10, 2, 1), (20, 3, 1)}
    # batch 2 runs with that after batch 1 (12): window 10 is emitted
    assert {tuple(r) for r in read_count_state(spark, run.checkpoint, batch_id=2).collect()} == {(20, 3, 1)}


def test_resume_two_runs_one_checkpoint(spark):
    run = _count_run(spark, "t-resume", split=1)
    got = {tuple(r) for r in spark.read.parquet(run.output).select("window_end_ms", "key", "n").collect()}
    assert got == _expected_drop(spark, split=1)[0]


def test_replay_files_follow_the_batches(spark):
    run = filereplay.new_run(spark, "t-files", SCHEMA, files_per_batch=2)
    rows = spark.range(60).selectExpr("id div 20 as b", "id as ts_ms", "id as key")
    seen = {}

    def start(src, r):
        return (src.writeStream.foreachBatch(lambda df, i: seen.update({i: sorted(x.key for x in df.collect())}))
                .option("checkpointLocation", r.checkpoint).trigger(availableNow=True).start())

    filereplay.replay(spark, rows, run, start, 3)
    assert seen == {i: list(range(20 * i, 20 * i + 20)) for i in range(3)}


def test_refire_writer_matches_batch_fire_log(spark):
    run = filereplay.new_run(spark, "t-refire", SCHEMA)
    state_dir = f"{run.root}/state"
    writer = refire.RefireWriter(state_dir, 10, n_partitions=2, clock=lambda b: 100 + 3 * b)

    def start(src, r):
        return src.writeStream.foreachBatch(writer).option("checkpointLocation", r.checkpoint) \
            .trigger(availableNow=True).start()

    filereplay.replay(spark, _rows(spark), run, start, BATCHES)
    got = {tuple(r) for r in refire.read_fire_log(spark, state_dir).collect()}
    rp = firelog.replay(_rows(spark), 10)
    assert got == {tuple(r) for r in firelog.fire_log(rp.fired, 2).collect()}
    for b in range(5):
        assert ({tuple(r) for r in refire.read_live(spark, state_dir, b).collect()}
                == {tuple(r) for r in firelog.live_at(rp.fired, b).collect()})
    # replaying a batch (as after a failure) changes nothing, also by a new writer whose clock has moved on
    batches = sorted(map(tuple, refire.read_batches(spark, state_dir).collect()))
    for again in (writer, refire.RefireWriter(state_dir, 10, n_partitions=2, clock=lambda b: 10**9)):
        again(spark.createDataFrame([(31, 1), (5, 9)], SCHEMA), 4)
        assert {tuple(r) for r in refire.read_fire_log(spark, state_dir).collect()} == got
        assert sorted(map(tuple, refire.read_batches(spark, state_dir).collect())) == batches


def _folders(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return {f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
            if f.isDirectory()}


def test_cleanup_keeps_state_bounded_and_readable(spark):
    """One window of 10 ms per 3 batches; a pause in firing after batch 12 lets the earlier fires go."""
    root = filereplay.new_run(spark, "t-clean", SCHEMA).root
    times = {b: 100 * b + (5000 if b > 12 else 0) for b in range(24)}
    kept = refire.RefireWriter(f"{root}/kept", 10, n_partitions=1, clock=times.get)
    clean = refire.RefireWriter(f"{root}/clean", 10, n_partitions=1, clock=times.get, cleanup_delay_ms=450)
    sizes = []
    for b in range(24):
        batch = spark.createDataFrame([(4 * b, b % 3), (4 * b + 1, 7)], SCHEMA)
        kept(batch, b)
        clean(batch, b)
        sizes.append(tuple(len(_folders(spark, f"{root}/clean/{x}")) for x in ("deltas", "fires", "log")))
        if b in (12, 23):
            for read in (lambda d: refire.read_live(spark, d),
                         lambda d, b=b: refire.read_retained(spark, d, times[b] + 100, 450)):
                assert sorted(map(tuple, read(f"{root}/clean").collect())) == sorted(map(tuple, read(f"{root}/kept").collect()))
    assert max(s[0] for s in sizes) <= 5
    assert sizes[13][1] < sizes[12][1]          # the pause cleared what had fired before it
    assert sizes[13][2] < sizes[12][2]


def test_memory_sink_listener_and_stop(spark):
    listener = ProgressLog()
    spark.streams.addListener(listener)
    try:
        src = (spark.readStream.format("rate").option("rowsPerSecond", "50").load()
               .select((F.col("value") % 3).alias("key")))
        counts = windowed_count(with_ingestion_time(src), 60_000)
        q = (counts.writeStream.outputMode("append").format("memory").queryName("wsmem")
             .trigger(processingTime="200 milliseconds").start())
        for _ in range(60):  # bounded wait for a few progress events
            q.awaitTermination(0.5)
            if len(q.recentProgress) >= 2:
                break
        assert q.isActive and len(q.recentProgress) >= 2
        q.stop()  # T11: cancellation
        assert not q.isActive
        for _ in range(20):  # listener events arrive asynchronously
            if listener.events:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert listener.events and listener.events.maxlen and {"batch_id", "rows", "state_rows", "dropped"} <= set(listener.events[0])


@pytest.mark.parametrize("strict,expected", [(True, set()), (False, {(10, 1, 1)})])
def test_strict_close_in_stream(spark, strict, expected):
    """max ts 10 with delay 0: the window ending at 10 stays open in parity mode, closes in Spark's default."""
    run = filereplay.new_run(spark, f"t-strict-{strict}", SCHEMA)
    # one file: two of the same millisecond may come in either order
    spark.createDataFrame([(5, 1), (10, 2)], SCHEMA).coalesce(1).write.parquet(f"{run.input_dir}/b=0")
    counts = windowed_count(with_event_time(filereplay.input_stream(spark, run)), 10, strict=strict)
    start_count(counts, run.output, run.checkpoint, trigger=AVAILABLE_NOW).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(run.output).collect()} == expected


def test_refire_seeded_from_table(spark):
    """T9 from a table: seeded open windows continue counting and fire when the watermark passes them."""
    run = filereplay.new_run(spark, "t-seed", SCHEMA)
    state_dir = f"{run.root}/state"
    writer = refire.RefireWriter(state_dir, 10, n_partitions=1, clock=lambda b: 100 + b)
    writer.seed(spark.createDataFrame([(10, 1, 2), (20, 5, 1)], "window_end_ms long, key long, n long"), 5)
    writer(spark.createDataFrame([(3, 1), (12, 2)], SCHEMA), 0)
    assert {tuple(r) for r in refire.read_fire_log(spark, state_dir).collect()} == {(0, 0, 10, 1, 3)}
    assert {tuple(r) for r in refire.read_live(spark, state_dir).collect()} == {(20, 5, 1), (20, 2, 1)}
    ret = refire.read_retained(spark, state_dir, at_ms=100, delay_ms=5)
    assert {(r.window_end_ms, r.key, r.n) for r in ret.collect()} == {(10, 1, 3)}
