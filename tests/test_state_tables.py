"""Bucketed state tables, the state's change feed, progress tables, answers and text sinks on streams, triggers."""

import re
import time

from pyspark.sql import functions as F

from windowstate.operators import counts, lookups, statetable
from windowstate.sources.keys import decode_keys
from windowstate.sources.sinks import pairs_frame, read_text_sink, start_text_sink, text_keys_frame
from windowstate.streaming import filereplay
from windowstate.streaming.answers import start_answers
from windowstate.streaming.state import read_count_changes, read_count_state, state_from_changes
from windowstate.streaming.windowed import (AVAILABLE_NOW, ProgressTable, observed, start_count, windowed_count, with_arrival_time,
                                            with_event_time)

SCHEMA = "ts_ms bigint, key bigint"
ROWS = [(0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 12, 3), (2, 4, 1), (2, 9, 4), (3, 25, 3), (3, 19, 5), (4, 31, 1), (4, 5, 9)]
BATCHES = 5


def frame(spark):
    return spark.createDataFrame(ROWS, "b long, ts_ms long, key long")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lookups_reuse_the_tables_buckets(spark):
    state = spark.range(2000).selectExpr("id % 50 * 10 as window_end_ms", "id as key", "id + 1 as n")
    name = statetable.write_state_table(state, 8)
    requests = spark.range(300).selectExpr("id as req_id", "id % 50 * 10 - 5 as ts_ms", "id as key")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = statetable.lookup_table(requests, name, 10)
        plan = plan_of(got)
        plain = plan_of(lookups.lookup(requests, state, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1        # the requests' only
    assert len(re.findall(r"Exchange hashpartitioning", plain)) == 2
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lookups.lookup(requests, state, 10).collect()))
    some = statetable.read_state_table(spark, name, 100, 120)
    assert some.count() == state.where("window_end_ms between 100 and 120").count()
    assert "GreaterThanOrEqual(window_end_ms,100)" in plan_of(some)
    spark.sql(f"drop table {name}")


def _count_run(spark, tag, split=None):
    def start(src, r):
        return start_count(windowed_count(with_event_time(src), 10), r.output, r.checkpoint, trigger=AVAILABLE_NOW)
    return filereplay.replay(spark, frame(spark), filereplay.new_run(spark, tag, SCHEMA), start, BATCHES, split)


def test_changes_add_up_to_the_state(spark):
    run = _count_run(spark, "t-changes")
    for b in range(BATCHES + 1):
        changes = read_count_changes(spark, run.checkpoint, 0, b)
        assert (sorted(map(tuple, state_from_changes(changes).collect()))
                == sorted(map(tuple, read_count_state(spark, run.checkpoint, b).collect())))
    gone = read_count_changes(spark, run.checkpoint, 2, 2).where("removed").select("window_end_ms", "key")
    assert {tuple(r) for r in gone.collect()} >= {(10, 1), (10, 2)}


def test_progress_table(spark):
    run = filereplay.new_run(spark, "t-progress", SCHEMA)
    log, started = ProgressTable(spark, f"{run.root}/progress"), []

    def start(src, r):
        started.append(start_count(windowed_count(with_event_time(observed(src)), 10), r.output, r.checkpoint, trigger=AVAILABLE_NOW))
        return started[-1]

    spark.streams.addListener(log)
    try:
        filereplay.replay(spark, frame(spark), run, start, BATCHES)
        got = {r["batch_id"]: tuple(r)[1:] for r in log.read(started[0].id, BATCHES).collect()}
    finally:
        spark.streams.removeListener(log)
    assert [got[b][:2] for b in range(BATCHES)] == [(3, 3), (1, 12), (2, 9), (2, 25), (2, 31)]
    assert got[4][2] == 1 and sum(g[2] for g in got.values()) == 1         # (5, 9) comes too late
    assert got[1][3] == 3                                                  # windows 10 (two keys) and 20


def test_arrival_time_is_the_files(spark):
    run = filereplay.new_run(spark, "t-arrival", "key bigint")
    seen = []

    def start(src, r):
        return (with_arrival_time(src).writeStream.foreachBatch(lambda df, i: seen.extend(
            (i, x["key"], x["ms"]) for x in df.select("key", F.unix_millis("ts").alias("ms")).collect()))
            .option("checkpointLocation", r.checkpoint).trigger(availableNow=True).start())

    filereplay.replay(spark, frame(spark).select("b", "key"), run, start, BATCHES)
    assert sorted(seen) == sorted((b, k, 1000 * b) for b, _, k in ROWS)


def test_answers_as_a_stream_static_join(spark):
    state = counts.tumbling_count(frame(spark), 10)
    requests = spark.range(40).selectExpr("id as req_id", "id as ts_ms", "id % 5 as key")
    run = filereplay.new_run(spark, "t-answers", "req_id bigint, ts_ms bigint, key bigint")
    rows = requests.selectExpr("req_id div 10 as b", "*")
    filereplay.replay(spark, rows, run, lambda src, r: start_answers(src, state, 10, r.output, r.checkpoint, trigger=AVAILABLE_NOW),
                      4, split=1)
    got = spark.read.parquet(run.output).select("req_id", "key", "window_end_ms", "n", "found")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lookups.lookup(requests, state, 10).collect()))


def test_text_sinks_write_once(spark):
    """Pairs and keys over a restart; a run that finds nothing new writes nothing."""
    ordered = spark.createDataFrame([(b, 10 * b + i, i) for b in range(BATCHES) for i in range(4)], "b long, ts_ms long, key long")
    run = filereplay.new_run(spark, "t-pairs", SCHEMA)

    def start(src, r):
        return start_text_sink(pairs_frame(windowed_count(with_event_time(src), 10)), r.output, r.checkpoint, AVAILABLE_NOW)

    filereplay.replay(spark, ordered, run, start, BATCHES, split=2)
    start(filereplay.input_stream(spark, run), run).awaitTermination()
    got = [r["value"] for r in read_text_sink(spark, run.output).collect()]
    assert sorted(got) == sorted(f"({i},1)" for _ in range(4) for i in range(4))
    keys = filereplay.new_run(spark, "t-keys", SCHEMA)
    filereplay.replay(spark, ordered, keys, lambda src, r: start_text_sink(text_keys_frame(src), r.output, r.checkpoint, AVAILABLE_NOW),
                      BATCHES, split=1)
    back = decode_keys(read_text_sink(spark, keys.output))
    assert sorted(r["key"] for r in back.collect()) == sorted(i for _ in range(BATCHES) for i in range(4))


def test_watermark_rises_with_each_trigger(spark):
    """A repeated trigger; data that comes between two triggers is one micro-batch, and moves the next one's watermark."""
    run = filereplay.new_run(spark, "t-trigger", SCHEMA, 1)
    filereplay.feed(frame(spark), run, [0])
    q = start_count(windowed_count(with_event_time(filereplay.input_stream(spark, run)), 10), run.output, run.checkpoint,
                    trigger={"processingTime": "200 milliseconds"})
    try:
        for b in range(1, BATCHES):
            _until(lambda b=b: len(_fed(q)) == b)
            filereplay.feed(frame(spark), run, [b])
        _until(lambda: len(_fed(q)) == BATCHES)
    finally:
        q.stop()
    marks = [p.eventTime.get("watermark") for p in _fed(q)]
    assert len(marks) == BATCHES and marks == sorted(marks) and len(set(marks)) >= 4
    assert marks[1:3] == ["1970-01-01T00:00:00.002Z", "1970-01-01T00:00:00.011Z"]       # strict: a millisecond below


def _fed(q):
    return [p for p in q.recentProgress if p.numInputRows]


def _until(done, timeout_s=60):
    end = time.monotonic() + timeout_s
    while not done():
        assert time.monotonic() < end
        time.sleep(0.05)


def test_replay_deals_a_batch_over_files(spark):
    """Files of a batch are written by many tasks, and equal rows are spread."""
    run = filereplay.new_run(spark, "t-deal", SCHEMA, 4)
    filereplay.feed(spark.range(400).selectExpr("id div 200 as b", "1L as ts_ms", "2L as key"), run, [0, 1])
    sizes = [r["count"] for r in spark.read.parquet(run.input_dir).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and min(sizes) >= 25
