"""Scale properties: distributed scan paths equal brute force; counts pre-aggregate; no pairwise joins."""

import random

import pytest
from pyspark.sql import functions as F

from windowstate.operators.scale import first_mark_after, running_max

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows_per_chunk", [1000, 40, 1])
@pytest.mark.parametrize("seed", range(2))
def test_running_max_equals_brute_force(spark, seed, rows_per_chunk):
    rnd = random.Random(seed)
    vals = [(b * b, rnd.randint(-50, 50)) for b in range(120)]
    rnd.shuffle(vals)
    df = spark.createDataFrame(vals, "b long, v long")
    got = {r.b: r.m for r in running_max(df, "b", "v", "m", rows_per_chunk=rows_per_chunk).collect()}
    best, expected = None, {}
    for b, v in sorted(vals):
        best = v if best is None else max(best, v)
        expected[b] = best
    assert got == expected


@pytest.mark.parametrize("rows_per_chunk", [1000, 30])
@pytest.mark.parametrize("strict", [True, False])
def test_first_mark_after_equals_brute_force(spark, strict, rows_per_chunk):
    rnd = random.Random(7)
    points = sorted({rnd.randint(0, 400) for _ in range(150)})
    marks, wm = [], 0
    for b in range(60):
        wm += rnd.choice([0, 0, 3, 7, 20])
        marks.append((b, wm))
    p_df = spark.createDataFrame([(p,) for p in points], "e long")
    m_df = spark.createDataFrame(marks, "b long, wm long")
    res = first_mark_after(p_df, "e", m_df, "wm", "b", "fb", strict=strict, rows_per_chunk=rows_per_chunk)
    got = {r.e: r.fb for r in res.collect()}
    assert got == {p: min((b for b, w in marks if (w > p if strict else w >= p)), default=None) for p in points}


def test_ordered_scans_of_many_rows(spark):
    """1.6 million rows at default settings (several chunks), against closed forms, twice on one frame."""
    n = 1_600_000
    df = spark.range(n).selectExpr("id as b", "case when id % 1000 = 0 then id else id - 5000 end as v")
    res = running_max(df, "b", "v", "m", n_rows=n)
    wrong = res.filter(F.col("m") != F.greatest(F.expr("b - b % 1000"), F.lit(-5000)))
    assert res.count() == n and wrong.count() == 0
    points = spark.range(n).selectExpr("id * 3 as e")
    marks = spark.range(n // 10).selectExpr("id as b", "id * 31 as wm")
    for _ in range(2):
        res = first_mark_after(points, "e", marks, "wm", "b", "fb", n_rows=n + n // 10)
        right = F.when(F.col("e") < 31 * (n // 10 - 1), F.expr("e div 31 + 1"))
        assert res.filter(~F.col("fb").eqNullSafe(right)).count() == 0


def test_counts_pre_aggregate_before_the_shuffle(spark):
    from windowstate.plans.catalog import q01_tumbling_count
    plan = q01_tumbling_count(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_no_pairwise_joins_in_batch_queries(spark):
    from windowstate.plans.catalog import BATCH_QUERIES
    for name, fn in BATCH_QUERIES.items():
        df = fn(spark, SF)
        df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
        spark.catalog.clearCache()
