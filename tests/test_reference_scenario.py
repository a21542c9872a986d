"""The reference's end-to-end test, with value checks: generator keys (10 keys, 4 generators) carrying no
timestamp (read as Long.MIN_VALUE), 1000 ms windows, and 10 000 seeded lookups at Long.MIN_VALUE."""

import random
from collections import Counter

from pyspark.sql import functions as F

from windowstate.operators import lookup, tumbling_count
from windowstate.sources.keys import key_sequence

MIN_LONG = -(2 ** 63)


def test_ten_thousand_lookups(spark):
    steps = 250
    seq = key_sequence(spark, 10, 4, steps)
    rows = seq.select(F.lit(MIN_LONG).cast("bigint").alias("ts_ms"), "key")
    counts = tumbling_count(rows, 1000)
    assert {r.window_end_ms for r in counts.collect()} == {-9223372036854774000}
    rnd = random.Random(42)
    asks = [(i, MIN_LONG, rnd.randrange(10)) for i in range(10_000)]
    req = spark.createDataFrame(asks, "req_id long, ts_ms long, key long")
    got = {r.req_id: (r.n, r.found) for r in lookup(req, counts, 1000).collect()}
    expected_counts = Counter((i * (10 // 4) + j) % 10 for i in range(4) for j in range(steps))
    assert got == {i: (expected_counts[k], True) for i, _, k in asks}
