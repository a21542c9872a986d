"""Registered streaming queries: the events table replayed through a file stream in arrival batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.operators import firelog
from windowstate.operators.retention import retained_view
from windowstate.operators.scale import write_table
from windowstate.plans.params import CLEANUP_MS, HOUR_MS, N_PARTITIONS, REPLAY_BATCH
from windowstate.session import scratch_dir
from windowstate.sources.keys import decode_keys
from windowstate.sources.sinks import pairs_frame, read_text_sink, start_text_sink, text_keys_frame
from windowstate.sources.tables import ARRIVAL_BATCHES, arrival_rows, read_table
from windowstate.streaming import filereplay as replay
from windowstate.streaming import keyed, refire
from windowstate.streaming.answers import start_answers
from windowstate.streaming.state import read_count_changes, read_count_state, state_from_changes
from windowstate.streaming.windowed import (AVAILABLE_NOW, EmitLog, ProgressTable, observed, start_count, windowed_count,
                                            with_arrival_time, with_event_time)

ROW_SCHEMA = "ts_ms bigint, key bigint"
INGEST_WINDOW_MS = 2_000   # arrival-time windows of the ingestion-time query (two replay batches each)
RESUME_SPLIT = 5           # the resume query's first run takes arrival batches 0..RESUME_SPLIT


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return arrival_rows(read_table(spark, sf, "events"), "user_id", "ts", "event_id")


def _count_run(spark: SparkSession, sf: str, tag: str, split: int | None = None) -> replay.ReplayRun:
    """The drop-mode count: what a batch brings for windows that the watermark before the previous batch had passed
    is dropped (the reference never drops; q24 is its parity mode)."""
    def start(src: DataFrame, run: replay.ReplayRun):
        counts = windowed_count(with_event_time(src), HOUR_MS, delay_ms=0, strict=True)
        return start_count(counts, run.output, run.checkpoint, trigger=AVAILABLE_NOW)
    return replay.replay(spark, _rows(spark, sf), replay.new_run(spark, tag, ROW_SCHEMA), start, ARRIVAL_BATCHES, split)


def q20_stream_count(spark, sf):
    """Drop mode: fewer pairs than q03, which counts late rows, too."""
    run = _count_run(spark, sf, "q20")
    return spark.read.parquet(run.output).select("window_end_ms", "key", "n")


def q21_state_read(spark, sf):
    run = _count_run(spark, sf, "q21")
    return read_count_state(spark, run.checkpoint)


def q22_state_history(spark, sf):
    run = _count_run(spark, sf, "q22")
    return read_count_state(spark, run.checkpoint, batch_id=REPLAY_BATCH)


def q23_resume(spark, sf):
    """Drop mode over two runs and one checkpoint."""
    run = _count_run(spark, sf, "q23", split=RESUME_SPLIT)
    return spark.read.parquet(run.output).select("window_end_ms", "key", "n")


def _refire_run(spark, sf, tag):
    run = replay.new_run(spark, tag, ROW_SCHEMA)
    state_dir = f"{run.root}/state"
    writer = refire.RefireWriter(state_dir, HOUR_MS, delay_ms=0, n_partitions=N_PARTITIONS,
                                 clock=lambda b: 1000 * b)

    def start(src: DataFrame, r: replay.ReplayRun):
        return (src.writeStream.foreachBatch(writer).option("checkpointLocation", r.checkpoint)
                .trigger(availableNow=True).start())

    replay.replay(spark, _rows(spark, sf), run, start, ARRIVAL_BATCHES)
    return run, state_dir


def q24_stream_refire(spark, sf):
    _, state_dir = _refire_run(spark, sf, "q24")
    return refire.read_fire_log(spark, state_dir)


def q28_lookup_stream(spark, sf):
    """L2 as a stream: after the re-fire replay, a request stream is answered against the committed state
    (live after the last batch, retained at that batch's time)."""
    from windowstate.plans.catalog import _requests
    run, state_dir = _refire_run(spark, sf, "q28")
    last_b = ARRIVAL_BATCHES - 1
    req_dir, out_dir = f"{run.root}/requests", f"{run.root}/answers"
    _requests(spark, sf).write.parquet(f"{req_dir}/part=0")
    writer = refire.LookupWriter(state_dir, out_dir, HOUR_MS, CLEANUP_MS, clock=lambda _b: 1000 * last_b)
    q = (spark.readStream.schema("req_id bigint, ts_ms bigint, key bigint").parquet(f"{req_dir}/*")
         .writeStream.foreachBatch(writer).option("checkpointLocation", f"{run.root}/lookup-checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir).select("req_id", "key", "window_end_ms", "n", "found")


def q25_ingestion_time(spark, sf):
    """T1 on a stream of keys without times: each record is stamped with the arrival of its file (1000*b for arrival
    batch b) and counted per arrival window; the windows that the stream emits and those still open in its state."""
    run = replay.new_run(spark, "q25", "key bigint")

    def start(src: DataFrame, r: replay.ReplayRun):
        counts = windowed_count(with_arrival_time(src), INGEST_WINDOW_MS, delay_ms=0, strict=True)
        return start_count(counts, r.output, r.checkpoint, trigger=AVAILABLE_NOW)

    replay.replay(spark, _rows(spark, sf).select("b", "key"), run, start, ARRIVAL_BATCHES)
    emitted = spark.read.schema("window_end_ms bigint, key bigint, n bigint").parquet(run.output)
    return emitted.unionByName(read_count_state(spark, run.checkpoint).select("window_end_ms", "key", "n"))


def q29_stream_lookup_drop(spark, sf):
    """Lookups over the built-in (drop-mode) stream: live windows from its state store, emitted windows kept by an
    EmitLog sink and read through the retention view. The windows that batch b's watermark passes are emitted by the
    next streaming batch, at its time; the view is read at the time of the batch after the last."""
    from windowstate.operators.lookups import lookup
    from windowstate.plans.catalog import _requests
    run = replay.new_run(spark, "q29", ROW_SCHEMA)
    state_dir = f"{run.root}/state"
    sink = EmitLog(state_dir, N_PARTITIONS, clock=lambda batch_id: 1000 * batch_id)

    def start(src: DataFrame, r: replay.ReplayRun):
        counts = windowed_count(with_event_time(src), HOUR_MS, delay_ms=0, strict=True)
        return (counts.writeStream.outputMode("append").foreachBatch(sink)
                .option("checkpointLocation", r.checkpoint).trigger(availableNow=True).start())

    replay.replay(spark, _rows(spark, sf), run, start, ARRIVAL_BATCHES)
    live = read_count_state(spark, run.checkpoint)
    retained = refire.read_retained(spark, state_dir, at_ms=1000 * ARRIVAL_BATCHES, delay_ms=CLEANUP_MS)
    return lookup(_requests(spark, sf), live, HOUR_MS, retained=retained)


def _keyed_run(spark, sf, tag, first=0, initial=None):
    """The keyed operator over arrival batches first..: its fires (a row each) and the windows open in its state."""
    run = replay.new_run(spark, tag, ROW_SCHEMA)

    def start(src: DataFrame, r: replay.ReplayRun):
        return start_count(keyed.keyed_windows(src, HOUR_MS, initial=initial), r.output, r.checkpoint, trigger=AVAILABLE_NOW)

    with keyed.rocksdb_state(spark):
        replay.replay(spark, _rows(spark, sf), run, start, ARRIVAL_BATCHES, first=first)
    return spark.read.schema(keyed.WINDOWS_SCHEMA).parquet(run.output), keyed.read_windows(spark, run.checkpoint)


def q33_keyed_refire(spark, sf):
    """Late rows and all, per window and key: what fired, in how many fires, and what is open."""
    fires, live = _keyed_run(spark, sf, "q33")
    zero = F.lit(0).cast("bigint")
    both = (fires.select("window_end_ms", "key", F.col("n").alias("n_fired"), F.lit(1).alias("n_fires"), zero.alias("n_live"))
            .unionByName(live.select("window_end_ms", "key", zero.alias("n_fired"), F.lit(0).alias("n_fires"),
                                     F.col("n").alias("n_live"))))
    total = both.groupBy("window_end_ms", "key").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_fired", "n_fires", "n_live")])
    return total.withColumn("n", F.col("n_fired") + F.col("n_live"))


def q34_keyed_seed(spark, sf):
    """The keyed operator starts from the windows open after arrival batch RESUME_SPLIT, as a table, and streams the
    rest: what it fires and what is open at the end."""
    fired = firelog.replay(_rows(spark, sf), HOUR_MS).fired
    seed = write_table(firelog.live_at(fired, RESUME_SPLIT), "q34-seed")
    fires, live = _keyed_run(spark, sf, "q34", first=RESUME_SPLIT + 1, initial=seed)
    both = (fires.select("window_end_ms", "key", "n", F.lit("fired").alias("origin"))
            .unionByName(live.select("window_end_ms", "key", "n", F.lit("live").alias("origin"))))
    return both.groupBy("window_end_ms", "key", "origin").agg(F.sum("n").cast("bigint").alias("n"))


def q35_state_changes(spark, sf):
    """The change feed of the count's state, added up to REPLAY_BATCH, is the state after it (q22)."""
    run = _count_run(spark, sf, "q35")
    return state_from_changes(read_count_changes(spark, run.checkpoint, 0, REPLAY_BATCH))


def q36_lookup_static(spark, sf):
    """L2 as a stream-static join: the request stream meets a table of the state after the last arrival batch, live and
    retained at its time (the rows of q28)."""
    from windowstate.operators.lookups import state_view
    from windowstate.plans.catalog import _requests
    last_b = ARRIVAL_BATCHES - 1
    rp = firelog.replay(_rows(spark, sf), HOUR_MS)
    flog = write_table(firelog.fire_log(rp.fired, N_PARTITIONS), "q36-fires")
    retained = retained_view(flog, rp.log, last_b, 1000 * last_b, CLEANUP_MS)
    state = write_table(state_view(firelog.live_at(rp.fired, last_b), retained), "q36-state")
    root = scratch_dir(spark, "q36")
    _requests(spark, sf).write.parquet(f"{root}/requests")
    requests = spark.readStream.schema("req_id bigint, ts_ms bigint, key bigint").parquet(f"{root}/requests")
    start_answers(requests, state, HOUR_MS, f"{root}/answers", f"{root}/checkpoint", trigger=AVAILABLE_NOW).awaitTermination()
    return spark.read.parquet(f"{root}/answers").select("req_id", "key", "window_end_ms", "n", "found")


def q38_progress(spark, sf):
    """A row per completed micro-batch of the drop-mode count: rows and latest time that came in, late (window, key)
    groups dropped, state rows held."""
    run = replay.new_run(spark, "q38", ROW_SCHEMA)
    log = ProgressTable(spark, f"{run.root}/progress")
    started = []

    def start(src: DataFrame, r: replay.ReplayRun):
        counts = windowed_count(with_event_time(observed(src)), HOUR_MS, delay_ms=0, strict=True)
        started.append(start_count(counts, r.output, r.checkpoint, trigger=AVAILABLE_NOW))
        return started[-1]

    spark.streams.addListener(log)
    try:
        replay.replay(spark, _rows(spark, sf), run, start, ARRIVAL_BATCHES)
        return log.read(started[-1].id, until_batch=started[-1].lastProgress.batchId)
    finally:
        spark.streams.removeListener(log)


def _in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The events in order of their times: none is late."""
    return arrival_rows(read_table(spark, sf, "events"), "user_id", "ts", "event_id", shuffled=False)


def q39_pair_sink(spark, sf):
    """S3: emitted pairs as text files, written by two runs over one checkpoint and read back (the pairs of q03)."""
    run = replay.new_run(spark, "q39", ROW_SCHEMA)

    def start(src: DataFrame, r: replay.ReplayRun):
        counts = windowed_count(with_event_time(src), HOUR_MS, delay_ms=0, strict=True)
        return start_text_sink(pairs_frame(counts), r.output, r.checkpoint, AVAILABLE_NOW)

    replay.replay(spark, _in_order(spark, sf), run, start, ARRIVAL_BATCHES, RESUME_SPLIT)
    return read_text_sink(spark, run.output).select(F.col("value").alias("pair"))


def q40_key_sink(spark, sf):
    """Keys as text files, written by a stream and decoded again."""
    run = replay.new_run(spark, "q40", ROW_SCHEMA)
    replay.replay(spark, _rows(spark, sf), run, lambda src, r: start_text_sink(
        text_keys_frame(src), r.output, r.checkpoint, AVAILABLE_NOW), ARRIVAL_BATCHES, RESUME_SPLIT)
    return decode_keys(read_text_sink(spark, run.output))


STREAM_QUERIES = {
    "q33_keyed_refire": q33_keyed_refire,
    "q34_keyed_seed": q34_keyed_seed,
    "q35_state_changes": q35_state_changes,
    "q36_lookup_static": q36_lookup_static,
    "q38_progress": q38_progress,
    "q39_pair_sink": q39_pair_sink,
    "q40_key_sink": q40_key_sink,
    "q20_stream_count": q20_stream_count,
    "q21_state_read": q21_state_read,
    "q22_state_history": q22_state_history,
    "q23_resume": q23_resume,
    "q24_stream_refire": q24_stream_refire,
    "q25_ingestion_time": q25_ingestion_time,
    "q28_lookup_stream": q28_lookup_stream,
    "q29_stream_lookup_drop": q29_stream_lookup_drop,
}
