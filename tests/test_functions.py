"""Column functions against the micro fixtures (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from tests import sim
from windowstate.functions import (answer_text, epoch_ms, key_partition, long_text, pair_text, parse_long,
                                   parse_request, window_end, window_start)
from windowstate.sources.keys import key_sequence

PARSE_CASES = [
    ("12", 12), ("", -1), (" 12", -1), ("12 ", -1), ("\t7\n", -1), ("12\n", -1), ("abc", -1), ("12L", -1),
    ("0x1", -1), ("+5", 5), ("-5", -5), ("9223372036854775807", 9223372036854775807),
    ("1.5", -1), ("1e3", -1), ("9223372036854775808", -1), ("007", 7), (None, -1),
    ("-9223372036854775808", -9223372036854775808), ("-9223372036854775809", -1), ("+-1", -1),
]


def test_parse_long(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(PARSE_CASES)], "i int, s string")
    got = {r.i: r.k for r in df.select("i", parse_long("s").alias("k")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(PARSE_CASES)}


def test_parse_long_drop_invalid_and_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"42"),), (bytearray(b"x"),)], "v binary")
    assert [r.k for r in df.select(parse_long("v", invalid=None).alias("k")).collect()] == [42, None]


def test_text_codecs(spark):
    df = spark.createDataFrame([(7, 3), (-1, 12)], "key long, n long")
    rows = df.select(pair_text("key", "n").alias("p"), long_text("key").alias("t")).collect()
    assert [(r.p, r.t) for r in rows] == [("(7,3)", "7"), ("(-1,12)", "-1")]


def test_answer_text(spark):
    df = spark.createDataFrame([(5, 2, True), (9, 0, False)], "key long, n long, found boolean")
    got = [r.a for r in df.select(answer_text("key", "n", "found").alias("a")).collect()]
    assert got == ["StateFound(key: 5, value: 2)", "StateNotFound(key: 9)"]


def test_window_alignment_negative(spark):
    ts = [-11, -10, -1, 0, 9, 10]
    df = spark.createDataFrame([(t,) for t in ts], "ts long")
    got = [r.s for r in df.select(window_start("ts", 10).alias("s")).collect()]
    assert got == [-10, -10, 0, 0, 0, 10]
    mn = spark.createDataFrame([(-(2 ** 63),)], "ts long").select(window_end("ts", 1000).alias("e")).first().e
    assert mn == -9223372036854774000


HASH_VECTORS = [(0, 614249093, 1), (1, 1758355818, 2), (2, 805035928, 0), (3, 587548879, 3), (7, 1600419106, 2),
                (9, 2059528126, 2), (42, 62218044, 0), (149, 753920661, 1), (-1, 614249093, 1),
                (10000, 746394989, 1), (2 ** 40 + 5, 667457507, 3), (-(2 ** 63), 67125006, 2)]


def test_key_partition_vectors(spark):
    df = spark.createDataFrame([(k,) for k, _, _ in HASH_VECTORS], "key long")
    got = {r.key: (r.h, r.partition) for r in key_partition(df, "key", 4, hash_col="h").collect()}
    assert got == {k: (h, p) for k, h, p in HASH_VECTORS}


def test_key_partition_matches_python(spark):
    keys = list(range(-200, 200)) + [2 ** 62 + 12345, -(2 ** 62) - 99, 2 ** 63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    got = {r.key: r.partition for r in key_partition(df, "key", 7).collect()}
    assert got == {k: sim.partition(k, 7) for k in keys}
    # keys 0-149 over 4 partitions (fixture counts)
    small = spark.range(150).withColumnRenamed("id", "key")
    counts = {r.partition: r["count"] for r in key_partition(small, "key", 4).groupBy("partition").count().collect()}
    assert counts == {0: 40, 1: 36, 2: 36, 3: 38}


def test_key_partition_filter_and_join_do_not_inline(spark):
    """A predicate or join on the partition column must not re-inline the hash chain into one huge expression."""
    df = key_partition(spark.range(1000).withColumnRenamed("id", "key"), "key", 4)
    other = key_partition(df.select("key"), "key", 3, part_col="p3")
    res = df.join(other, "key").filter((F.col("partition") == 2) & (F.col("p3") != F.col("partition")))
    assert res.count() == sum(1 for k in range(1000) if sim.partition(k, 4) == 2 and sim.partition(k, 3) != 2)


REQUESTS = [("7", ("lookup", 1000, 7)), ("1000,7", ("lookup", 1000, 7)), ("1,2,3", ("lookup", -1, -1)),
            ("x", ("invalid", None, None)), ("STOP", ("stop", None, None)), ("quit", ("stop", None, None)),
            ("7,", ("lookup", 1000, 7)), (",7", ("invalid", None, None)), (",", ("lookup", -1, -1)),
            ("", ("invalid", None, None)), ("5,x", ("invalid", None, None)), ("-3,+4", ("lookup", -3, 4))]


def test_parse_request(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(REQUESTS)], "i int, line string")
    rows = df.select("i", parse_request("line", 1000).alias("r")).select("i", "r.*").collect()
    assert {r.i: (r.command, r.ts_ms, r.key) for r in rows} == {i: e for i, (_, e) in enumerate(REQUESTS)}


def test_epoch_ms_independent_of_zone(spark):
    import datetime as dt
    import calendar
    stamps = [dt.datetime(2024, 1, 1, 0, 0, 7, 179575), dt.datetime(2024, 3, 10, 2, 30, 0, 1),
              dt.datetime(2024, 7, 1, 12, 0, 0, 999999), dt.datetime(1960, 1, 1, 0, 0, 0, 1500)]
    ntz = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    expected = [(calendar.timegm(s.timetuple()) * 1_000_000 + s.microsecond) // 1000 for s in stamps]
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert [r.m for r in ntz.select(epoch_ms(ntz, "ts").alias("m")).collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_key_sequence(spark):
    rows = key_sequence(spark, 10, 4, 3).collect()
    seq = {}
    for r in rows:
        seq.setdefault(r.subtask, []).append((r.idx, r.key))
    assert {s: [k for _, k in sorted(v)] for s, v in seq.items()} == {0: [0, 1, 2], 1: [2, 3, 4], 2: [4, 5, 6],
                                                                     3: [6, 7, 8]}
    # fewer keys than generators: every generator starts at 0
    assert sorted({r.key for r in key_sequence(spark, 3, 4, 1).collect()}) == [0]


@pytest.mark.parametrize("wm,closed", [(10, False), (11, True)])
def test_close_boundary(spark, wm, closed):
    from windowstate.operators.counts import with_closed_flag
    df = spark.createDataFrame([(10, 1, 1)], "window_end_ms long, key long, n long")
    assert with_closed_flag(df, wm).first().closed is closed


def test_request_tokens_split_on_whitespace(spark):
    from windowstate.functions.requests import request_tokens
    lines = spark.createDataFrame([(0, "1000, 7"), (1, "  8  "), (2, "stop 9")], "line_id long, line string")
    toks = [r.line for r in request_tokens(lines).orderBy("req_id").collect()]
    assert toks == ["1000,", "7", "8", "stop", "9"]
    parsed = request_tokens(lines).select("req_id", parse_request("line", 5).alias("r")).select("req_id", "r.*")
    asked = parsed.filter(F.col("command") == "lookup").orderBy("req_id").collect()
    assert [(r.ts_ms, r.key) for r in asked] == [(5, 1000), (5, 7), (5, 8), (5, 9)]


def test_request_tokens_of_large_line_ids(spark):
    """Ids as monotonically_increasing_id gives them from file partition 1024 on, and lines of many tokens."""
    from windowstate.functions.requests import request_tokens
    lines = spark.createDataFrame([(1024 << 33, "1 2"), ((1 << 63) - 1, "3"), (5000 << 33, "4")], "line_id long, line string")
    assert [r.line for r in request_tokens(lines).orderBy("req_id").collect()] == ["1", "2", "4", "3"]


def test_request_lines_keep_their_order_over_files(spark, tmp_path):
    from windowstate.functions.requests import read_request_lines, request_tokens
    for name, first in (("b.txt", 1000), ("a.txt", 0), ("c.txt", 2000)):
        (tmp_path / name).write_text("".join(f"{first + i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = [int(r.line) for r in request_tokens(read_request_lines(spark, str(tmp_path))).orderBy("req_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [k + i for k in (0, 1000, 2000) for i in range(500)]


def test_scratch_folder_needs_a_shared_one_off_local_mode():
    from types import SimpleNamespace

    from windowstate.session import ensure_checkpoint_dir
    unset = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: unset, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=unset))


def test_column_keys_and_codecs(spark):
    from windowstate.operators.counts import tumbling_count
    from windowstate.sources.keys import decode_keys
    from windowstate.sources.sinks import pairs_frame
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, 20)], "ts_ms long, k long")
    assert {tuple(r) for r in tumbling_count(rows, 10, key=F.col("k") % 10).collect()} == {(10, 0, 2), (10, 1, 1)}
    keys = decode_keys(spark.createDataFrame([("0x1f",)], "value string"), decode=lambda v: F.conv(F.substr(v, F.lit(3)), 16, 10).cast("long"))
    assert keys.first().key == 31
    pair = pairs_frame(spark.createDataFrame([(1, 2)], "key long, n long"), encode=lambda k, n: F.concat_ws("=", k, n))
    assert pair.first().value == "1=2"
