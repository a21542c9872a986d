"""The window job and lookup client programs, end to end on files."""

import datetime as dt

import pytest

from windowstate.job import answer_requests, start_window_job
from windowstate.session import scratch_dir

UTC = dt.timezone.utc


def _ts(ms):
    return dt.datetime.fromtimestamp(ms / 1000, tz=UTC).replace(tzinfo=None)


@pytest.mark.parametrize("late", ["refire", "drop"])
def test_window_job_and_lookups(spark, late):
    root = scratch_dir(spark, f"t-job-{late}")
    rows = [("1", 1_000), ("1", 2_000), ("2", 3_000), ("x", 4_000), ("3", 25_000)]
    spark.createDataFrame([(v, _ts(t)) for v, t in rows], "value string, ts timestamp_ntz") \
        .write.parquet(f"{root}/in/part=0")
    src = spark.readStream.schema("value string, ts timestamp_ntz").parquet(f"{root}/in/*")
    q = start_window_job(spark, src, f"{root}/sink", f"{root}/job", window_size=10_000, cleanup_delay=5_000,
                         late=late, partitions=2, event_time_column="ts", available_now=True)
    q.awaitTermination()
    # windows ending at 10 000 closed (watermark 25 000): pairs (1,2), (2,1), (-1,1) for the bad line
    assert sorted(r.value for r in spark.read.text(f"{root}/sink").collect()) == ["(-1,1)", "(1,2)", "(2,1)"]
    lines = spark.createDataFrame([(0, "5000,1"), (1, "5000,2"), (2, "25000,3"), (3, "bad"), (4, "5000,7"),
                                   (5, "stop"), (6, "5000,1")], "req_id long, line string")
    ans = {r.req_id: r.answer for r in answer_requests(spark, lines, f"{root}/job", 10_000, 5_000, now_ms=0,
                                                        late=late).collect()}
    assert ans == {0: "StateFound(key: 1, value: 2)", 1: "StateFound(key: 2, value: 1)",
                   2: "StateFound(key: 3, value: 1)", 4: "StateNotFound(key: 7)",
                   6: "StateFound(key: 1, value: 2)"}


def test_kafka_options(spark, tmp_path):
    import argparse

    from windowstate.job import sources
    ap = argparse.ArgumentParser()
    args = argparse.Namespace(source_path=str(tmp_path), source_format="text", brokers="h:9", source=None, sink="out", sink_path=None)
    source, sink = sources(spark, args, ap)
    assert source.isStreaming and callable(sink)
    args.sink = None
    with pytest.raises(SystemExit):
        sources(spark, args, ap)
    args.source_path, args.sink_path = None, "/tmp/x"
    with pytest.raises(SystemExit):
        sources(spark, args, ap)
