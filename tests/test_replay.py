"""Fire log, live state, retention and lookups against FIXTURES.md and a row-at-a-time simulation."""

import random

import pytest
from pyspark.sql import functions as F

from tests import sim
from windowstate.operators import firelog, lookups, retention

ROWS_SCHEMA = "b long, ts_ms long, key long"


def _t_expr(t_of):
    pairs = []
    for b, t in sorted(t_of.items()):
        pairs += [F.lit(b), F.lit(t)]
    return F.create_map(*pairs)[F.col("b")]


def _replay(spark, rows, size, t_of):
    df = spark.createDataFrame(rows, ROWS_SCHEMA)
    return firelog.replay(df, size, t_ms=_t_expr(t_of))


# FIXTURES.md §4 "late re-fire and retention": size 10, one partition, cleanup delay 5 ms
FIX_ROWS = [(0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 12, 3), (2, 4, 1), (3, 25, 3)]
FIX_T = {0: 100, 1: 103, 2: 106, 3: 112}


def test_fixture_fire_log(spark):
    rp = _replay(spark, FIX_ROWS, 10, FIX_T)
    got = {tuple(r) for r in firelog.fire_log(rp.fired, 1).collect()}
    assert got == {(1, 0, 10, 1, 2), (1, 0, 10, 2, 1), (2, 0, 10, 1, 1), (3, 0, 20, 3, 1)}


@pytest.mark.parametrize("batch,live,retained", [
    (0, {(10, 1, 2), (10, 2, 1)}, set()),
    (1, {(20, 3, 1)}, {(10, 1, 2), (10, 2, 1)}),
    (2, {(20, 3, 1)}, {(10, 1, 1)}),
    (3, {(30, 3, 1)}, {(20, 3, 1)}),
])
def test_fixture_live_and_retained(spark, batch, live, retained):
    rp = _replay(spark, FIX_ROWS, 10, FIX_T)
    assert {tuple(r) for r in firelog.live_at(rp.fired, batch).collect()} == live
    flog = firelog.fire_log(rp.fired, 1)
    view = retention.retained_view(flog, rp.log, batch, FIX_T[batch], 5)
    assert {(r.window_end_ms, r.key, r.n) for r in view.collect()} == retained


def test_fixture_lookups_after_batch_2(spark):
    rp = _replay(spark, FIX_ROWS, 10, FIX_T)
    flog = firelog.fire_log(rp.fired, 1)
    live = firelog.live_at(rp.fired, 2)
    ret = retention.retained_view(flog, rp.log, 2, 106, 5)
    req = spark.createDataFrame([(0, 5, 1), (1, 5, 2), (2, 10, 3), (3, 5, 99), (4, None, 3)],
                                "req_id long, ts_ms long, key long")
    got = {r.req_id: (r.window_end_ms, r.n, r.found)
           for r in lookups.lookup(req, live, 10, retained=ret, now_ms=12).collect()}
    assert got == {0: (10, 1, True), 1: (10, 0, False), 2: (20, 1, True), 3: (10, 0, False), 4: (20, 1, True)}


def test_state_view_live_shadows_retained(spark):
    live = spark.createDataFrame([(10, 1, 5)], "window_end_ms long, key long, n long")
    ret = spark.createDataFrame([(0, 10, 1, 2, 1), (0, 10, 2, 3, 1)],
                                "partition int, window_end_ms long, key long, n long, fire_b long")
    got = {(r.key, r.n, r.origin) for r in lookups.state_view(live, ret).collect()}
    assert got == {(1, 5, "live"), (2, 3, "retained")}


def _random_case(seed):
    rnd = random.Random(seed)
    n_batches = rnd.randint(3, 7)
    rows = []
    base = 0
    for b in range(n_batches):
        base += rnd.randint(0, 12)
        for _ in range(rnd.randint(1, 6)):
            rows.append((b, max(-15, base + rnd.randint(-25, 8)), rnd.randint(0, 5)))
    t, t_of = 100, {}
    for b in range(n_batches):
        t += rnd.choice([1, 2, 4, 6])
        t_of[b] = t
    return rows, t_of, n_batches, rnd.choice([3, 5, 8]), rnd.choice([1, 2, 3])


@pytest.mark.parametrize("seed", range(4))
def test_against_simulation(spark, seed):
    rows, t_of, n_batches, delay, n_part = _random_case(seed)
    size = 10
    rp = _replay(spark, rows, size, t_of)
    flog = firelog.fire_log(rp.fired, n_part).persist()
    full_fires, _, _, _ = sim.simulate(rows, t_of.get, size, delay, n_part, n_batches, t_of[n_batches - 1])
    assert {tuple(r) for r in flog.collect()} == full_fires
    for batch in range(n_batches):
        for at in (t_of[batch], t_of[batch] + delay, t_of[batch] + delay + 1):
            _, live, retained, _ = sim.simulate(rows, t_of.get, size, delay, n_part, batch, at)
            got_live = {(r.window_end_ms, r.key): r.n for r in firelog.live_at(rp.fired, batch).collect()}
            assert got_live == live
            view = retention.retained_view(flog, rp.log, batch, at, delay)
            assert {(r.partition, r.window_end_ms, r.key, r.n) for r in view.collect()} == retained
    # invariant: everything is either emitted or live
    total = sum(r.n for r in flog.collect()) + sum(live.values())
    assert total == len(rows)
    flog.unpersist()


def test_retained_since_restart(spark):
    """After a restart at t=105 the reference has lost the windows retained by the fire at t=103."""
    rp = _replay(spark, FIX_ROWS, 10, FIX_T)
    flog = firelog.fire_log(rp.fired, 1)
    kept = retention.retained_view(flog, rp.log, 1, 104, 5)
    lost = retention.retained_view(flog, rp.log, 1, 104, 5, retained_since=105)
    assert kept.count() == 2 and lost.count() == 0
