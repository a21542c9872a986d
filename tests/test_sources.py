"""Sources and sinks: stream decode of text keys (S1 path over files), key sequences (S2), text payloads."""

from windowstate.session import scratch_dir
from windowstate.sources import decode_keys, key_sequence_stream, pairs_frame, text_keys_frame
from windowstate.sources.keys import kafka_key_reader


def test_decode_keys_on_a_stream(spark):
    root = scratch_dir(spark, "t-decode")
    spark.createDataFrame([("12",), ("x",), ("-3",), (" 4",)], "value string").write.parquet(f"{root}/in")
    src = spark.readStream.schema("value string").parquet(f"{root}/in")
    q = (decode_keys(src).writeStream.format("memory").queryName("decoded").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.key for r in spark.sql("select key from decoded").collect()) == [-3, -1, -1, 12]
    dropped = decode_keys(spark.createDataFrame([("1",), ("y",)], "value string"), invalid=None)
    assert [r.key for r in dropped.collect()] == [1]
    dropped = decode_keys(spark.createDataFrame([("1",), ("y",)], "value string"), drop_invalid=True)
    assert [r.key for r in dropped.collect()] == [1]


def test_key_sequence_stream(spark):
    src = key_sequence_stream(spark, num_keys=10, parallelism=4, rows_per_second=8, micro_batch=True)
    q = (src.writeStream.format("memory").queryName("seq").outputMode("append")
         .trigger(processingTime="100 milliseconds").start())
    try:
        for _ in range(60):
            q.awaitTermination(0.5)
            if spark.sql("select count(*) c from seq").first().c >= 12:
                break
    finally:
        q.stop()
    rows = spark.sql("select subtask, idx, key from seq where idx < 3").collect()
    got = {}
    for r in rows:
        got.setdefault(r.subtask, {})[r.idx] = r.key
    assert got == {0: {0: 0, 1: 1, 2: 2}, 1: {0: 2, 1: 3, 2: 4}, 2: {0: 4, 1: 5, 2: 6}, 3: {0: 6, 1: 7, 2: 8}}


def test_text_payloads(spark):
    counts = spark.createDataFrame([(10, 5, 2)], "window_end_ms long, key long, n long")
    assert pairs_frame(counts).first().value == "(5,2)"
    assert text_keys_frame(counts).first().value == "5"


def test_kafka_reader_is_configured(spark):
    reader = kafka_key_reader(spark, "broker:9092", "keys")
    assert reader is not None  # building the reader needs no connector; load() does
