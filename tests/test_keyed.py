"""The keyed operator on Spark's state: late rows, boundary, restart, seeding, hot keys, retention by time-to-live."""

import time

import pytest
from pyspark.sql import functions as F

from windowstate.operators import firelog
from windowstate.streaming import filereplay, keyed
from windowstate.streaming.windowed import AVAILABLE_NOW, start_count

SCHEMA = "ts_ms bigint, key bigint"
ROWS = [(0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 12, 3), (2, 4, 1), (2, 9, 4), (3, 25, 3), (3, 19, 5), (4, 30, 1), (4, 5, 9)]
BATCHES = 5


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "b long, ts_ms long, key long")


def run_keyed(spark, tag, rows, batches, split=None, first=0, initial=None, size=10, delay=0):
    run = filereplay.new_run(spark, tag, SCHEMA)

    def start(src, r):
        return start_count(keyed.keyed_windows(src, size, delay, initial), r.output, r.checkpoint, trigger=AVAILABLE_NOW)

    with keyed.rocksdb_state(spark):
        filereplay.replay(spark, rows, run, start, batches, split, first=first)
    fires = spark.read.schema(keyed.WINDOWS_SCHEMA).parquet(run.output)
    return run, sorted(map(tuple, fires.collect())), sorted(map(tuple, keyed.read_windows(spark, run.checkpoint).collect()))


def expected(rows, size=10):
    """A row-at-a-time model: a batch's rows, then every window below the watermark of the batches before it."""
    open_, fires, wm = {}, [], None
    batches = sorted({b for b, _, _ in rows})
    for b in [*batches, None]:
        for _, ts, key in [r for r in rows if r[0] == b]:
            end = ts - ts % size + size
            open_[end, key] = open_.get((end, key), 0) + 1
        for (end, key), n in sorted(open_.items()):
            if wm is not None and end < wm:
                fires.append((end, key, n))
                del open_[end, key]
        wm = max([wm or 0, *[ts for x, ts, _ in rows if x == b]])
    return sorted(fires), sorted((e, k, n) for (e, k), n in open_.items())


def test_late_rows_fire_again_and_the_close_is_strict(spark):
    _, fires, live = run_keyed(spark, "t-keyed", frame(spark), BATCHES)
    assert (fires, live) == expected(ROWS)
    assert (10, 1, 3) in fires and (10, 9, 1) in fires          # batch 4's row of a window closed long before
    assert (30, 3, 1) in live                                    # its end is the watermark


def test_restart_changes_nothing(spark):
    """A second run over the checkpoint goes on with the state; the no-data batch between them only fires earlier."""
    _, fires, live = run_keyed(spark, "t-keyed-split", frame(spark), BATCHES, split=2)
    total = {}
    for e, k, n in fires + live:
        total[e, k] = total.get((e, k), 0) + n
    want = {}
    for _, ts, k in ROWS:
        want[ts - ts % 10 + 10, k] = want.get((ts - ts % 10 + 10, k), 0) + 1
    assert total == want and live == expected(ROWS)[1]


def test_seeded_state_equals_a_full_run(spark):
    rp = firelog.replay(frame(spark), 10)
    seed = firelog.live_at(rp.fired, 1)
    before = firelog.fire_log(rp.fired).where("fire_b <= 1").drop("fire_b")
    _, fires, live = run_keyed(spark, "t-seed", frame(spark), BATCHES, first=2, initial=seed)
    total = {}
    for e, k, n in [*fires, *map(tuple, before.collect())]:
        total[e, k] = total.get((e, k), 0) + n
    whole = {}
    for e, k, n in expected(ROWS)[0]:
        whole[e, k] = whole.get((e, k), 0) + n
    assert total == whole and live == expected(ROWS)[1]


def test_state_by_batch(spark):
    run, _, _ = run_keyed(spark, "t-keyed-hist", frame(spark), BATCHES)
    at = keyed.read_windows(spark, run.checkpoint, batch_id=1)
    assert sorted(map(tuple, at.collect())) == [(10, 1, 2), (10, 2, 1), (20, 3, 1)]


def test_hot_key_is_counted_before_the_shuffle(spark):
    """Rows of one key leave a task as a row per Arrow batch and window, keys and times as large as they come."""
    big = (1 << 60) + 1
    rows = spark.range(50_000).selectExpr("id % 20 as ts_ms", f"if(id % 3 = 0, {big}, id % 5) as key")
    rows = rows.unionByName(spark.createDataFrame([(7, None), (None, 4)], SCHEMA))
    part = keyed.partial_counts(rows.coalesce(2), 10)
    got = part.where("n > 0").groupBy("window_end_ms", "key").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    want = rows.where("ts_ms is not null").selectExpr("ts_ms - ts_ms % 10 + 10 as window_end_ms", "key").groupBy(
        "window_end_ms", "key").count()
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert got.agg(F.max("parts")).first()[0] <= 8
    assert part.where("n = 0").agg(F.max("tick_ms")).first()[0] == 19


def test_many_keys_of_a_window_are_few_entries_of_the_state(spark):
    """Calls to the state go with windows and buckets, not with keys."""
    keys, n_buckets = 3_000, keyed.BUCKETS
    rows = spark.range(2 * keys).selectExpr("id % 2 as b", "5 as ts_ms", "id div 2 as key")
    run, fires, _ = run_keyed(spark, "t-keyed-many", rows, 2)
    entries = spark.read.format("statestore").option("stateVarName", keyed.COUNTS).load(run.checkpoint)
    assert entries.count() <= 2 * n_buckets
    live = keyed.read_windows(spark, run.checkpoint)
    assert fires == [] and live.count() == keys and live.where("window_end_ms = 10 and n = 2").count() == keys


class FakeState:
    """Handle and variables of a group."""

    def __init__(self):
        self.items, self.value, self.timers = [], None, []

    def getListState(self, _name, _schema):
        class Runs:
            get, appendValue, clear = (lambda _: iter(list(self.items))), (lambda _, x: self.items.append(x)), (
                lambda _: self.items.clear())
        return Runs()

    def getValueState(self, _name, _schema):
        class Value:
            get, update, clear = (lambda _: self.value), (lambda _, x: setattr(self, "value", x)), (
                lambda _: setattr(self, "value", None))
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


def test_runs_of_a_long_open_window_are_summed():
    """A hot key in every micro-batch does not make the state grow with their number; large runs are cut."""
    state, op = FakeState(), keyed.WindowCounts()
    op.init(state)
    row = lambda key, n: type("R", (), {"key": key, "n": n})
    most = 0
    for batch in range(3_000):
        op.handleInputRows((10, 3), iter([row(7, 2), row(batch % 50, 1), row(None, 0)]), None)
        most = max(most, sum(len(k) for k, _ in state.items))
    assert most <= keyed.MIN_SUMMED + 2 and state.timers == [11]
    op.handleInputRows((10, 3), (row(100 + i, 1) for i in range(25_000)), None)
    assert max(len(k) for k, _ in state.items) <= keyed.RUN_ROWS
    got = {r.key: r.n for r in op.handleExpiredTimer((10, 3), None, None)}
    want = {k: 60 for k in range(50)} | {100 + i: 1 for i in range(25_000)}
    assert got == {**want, 7: 60 + 6_000} and state.items == [] and state.value is None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_replays(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(b, max(0, 12 * b + rng.randint(-30, 12)), rng.randint(0, 3)) for b in range(6) for _ in range(8)]
    _, fires, live = run_keyed(spark, f"t-random-{seed}", frame(spark, rows), 6)
    assert (fires, live) == expected(rows)


def test_retained_windows_expire(spark):
    """Entries are readable for the delay; after it state rows fall, and a key that fires again doesn't see them."""
    run = filereplay.new_run(spark, "t-ttl", keyed.WINDOWS_SCHEMA, 1)
    readable = []

    def feed(rows, batch):
        filereplay.feed(spark.createDataFrame([(batch, *r) for r in rows], f"b long, {keyed.WINDOWS_SCHEMA}"), run, [batch])

    def note(df, _):
        rows = sorted(map(tuple, df.collect()))
        if rows:
            readable.append(rows)

    def state_rows():
        return q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress and q.lastProgress.stateOperators else 0

    feed([(10, 1, 5), (20, 1, 6), (10, 2, 7)], 0)
    with keyed.rocksdb_state(spark):
        q = (keyed.retained_windows(filereplay.input_stream(spark, run), 6_000).writeStream.outputMode("update")
             .foreachBatch(note).option("checkpointLocation", run.checkpoint).trigger(processingTime="300 milliseconds").start())
        try:
            until(lambda: len(readable) == 1)
            feed([(10, 1, 1)], 1)                                 # replaces that window's count
            until(lambda: len(readable) == 2 and state_rows() > 0)
            until(lambda: state_rows() == 0)                      # micro-batches without rows drop what has expired
            feed([(30, 1, 9)], 2)
            until(lambda: len(readable) == 3)
        finally:
            q.stop()
    assert readable == [[(10, 1, 5), (10, 2, 7), (20, 1, 6)], [(10, 1, 1), (20, 1, 6)], [(30, 1, 9)]]
    assert (30, 1, 9) in set(map(tuple, keyed.read_windows(spark, run.checkpoint, keyed.RETAINED).collect()))


def until(done, timeout_s=40):
    end = time.monotonic() + timeout_s
    while not done():
        assert time.monotonic() < end
        time.sleep(0.1)
