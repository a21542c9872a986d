"""The window job and the lookup client as programs, with the reference's parameters.

  python -m windowstate.job window --source-path IN --sink-path OUT --state-path STATE \\
      [--window-size 10000] [--window-cleanup-delay 2000] [--checkpoint 1000] [--late refire|drop] \\
      [--partitions 4] [--source-format text|parquet] [--event-time-column ts] [--available-now]
  python -m windowstate.job window --brokers HOSTS --source TOPIC --sink TOPIC --state-path STATE [...]
  python -m windowstate.job query --state-path STATE --requests FILE [--window-size 10000] \\
      [--window-cleanup-delay 2000] [--now MS] --output DIR

The window job reads decimal keys (text lines or a `value` column of files, or a Kafka topic), stamps them with
ingestion time unless an event-time column is named, counts per tumbling window, emits '(key,count)' to the sink when
the watermark passes a window, and keeps its state under --state-path (checkpoint, fire log, batch log; late rows
re-fire by default; what the cleanup delay has passed is removed). The lookup client reads request lines (`key` or
`time,key`), answers each from live state first, then retained windows, and writes the answers, with
'StateFound(key: K, value: V)' / 'StateNotFound(key: K)', to --output."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.functions.codec import answer_text
from windowstate.functions.requests import parse_request, read_request_lines, request_tokens
from windowstate.functions.timecols import epoch_ms
from windowstate.operators.lookups import lookup
from windowstate.sources.keys import decode_keys, kafka_key_reader
from windowstate.sources.sinks import kafka_sink
from windowstate.streaming.refire import RefireWriter, last_batch, read_live, read_retained
from windowstate.streaming.state import read_count_state
from windowstate.streaming.windowed import EmitLog, windowed_count, with_event_time, with_ingestion_time

# ---- fixed values: the reference's parameter defaults (ms) ----
WINDOW_SIZE_MS = 10_000
CLEANUP_DELAY_MS = 2_000
CHECKPOINT_MS = 1_000
# -----------------------------------------------------------------
DEFAULT_PARTITIONS = 4


def key_source(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Streaming decimal keys from files: text lines or parquet with a `value` column."""
    if fmt == "text":
        return spark.readStream.text(path)
    return spark.readStream.schema("value string").parquet(path)


def start_window_job(spark: SparkSession, source: DataFrame, sink_path: str | None, state_path: str,
                     window_size: int = WINDOW_SIZE_MS, cleanup_delay: int = CLEANUP_DELAY_MS,
                     checkpoint: int = CHECKPOINT_MS, late: str = "refire", partitions: int = DEFAULT_PARTITIONS,
                     event_time_column: str | None = None, available_now: bool = False, decode=None, encode=None,
                     sink=None):
    """Start the window job on a streaming frame with a `value` column; returns the StreamingQuery. `decode` and
    `encode` are Column functions from the value to the key and from (key, count) to the sink's value (U3);
    `sink(pairs, batch_id)` takes each batch's pairs besides or instead of the text folder."""
    state_path = state_path.rstrip("/")
    keys = decode_keys(source, "value", time_col=event_time_column, decode=decode)
    if not event_time_column:
        keys = with_ingestion_time(keys)
    keys = keys.select(epoch_ms(keys, "ts").alias("ts_ms"), "key")
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{checkpoint} milliseconds"}
    if late == "refire":
        writer = RefireWriter(f"{state_path}/state", window_size, n_partitions=partitions, sink_dir=sink_path,
                              cleanup_delay_ms=cleanup_delay, encode=encode, sink=sink)
        w = keys.writeStream.foreachBatch(writer)
    elif late == "drop":
        counts = windowed_count(with_event_time(keys), window_size)
        writer = EmitLog(f"{state_path}/state", partitions, sink_dir=sink_path, encode=encode, sink=sink)
        w = counts.writeStream.outputMode("append").foreachBatch(writer)
    else:
        raise ValueError("late must be 'refire' or 'drop'")
    return w.option("checkpointLocation", f"{state_path}/checkpoint").trigger(**trigger).start()


def answer_requests(spark: SparkSession, lines: DataFrame, state_path: str, window_size: int = WINDOW_SIZE_MS,
                    cleanup_delay: int = CLEANUP_DELAY_MS, now_ms: int | None = None,
                    late: str = "refire") -> DataFrame:
    """`(req_id, key, window_end_ms, n, found, answer)` for request lines `(req_id, line)` against a window job's
    state; every request is answered, commands and invalid lines ask for nothing."""
    state_path = state_path.rstrip("/")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    parsed = lines.select("req_id", parse_request("line", now).alias("r")).select("req_id", "r.*")
    asked = parsed.filter(F.col("command") == "lookup").select("req_id", "ts_ms", "key")
    last_b = last_batch(spark, f"{state_path}/state")[0]         # one snapshot for both
    if late == "refire":
        live = read_live(spark, f"{state_path}/state", last_b)
    else:
        live = read_count_state(spark, f"{state_path}/checkpoint")
    retained = read_retained(spark, f"{state_path}/state", now, cleanup_delay, last_b)
    out = lookup(asked, live, window_size, retained=retained)
    return out.withColumn("answer", answer_text("key", "n", "found"))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="windowstate.job")
    sub = ap.add_subparsers(dest="cmd", required=True)
    wj = sub.add_parser("window")
    wj.add_argument("--source-path")
    wj.add_argument("--brokers", help="Kafka; with --source and --sink instead of the paths")
    wj.add_argument("--source", help="topic of keys")
    wj.add_argument("--sink", help="topic of pairs")
    wj.add_argument("--source-format", default="text", choices=["text", "parquet"])
    wj.add_argument("--sink-path")
    wj.add_argument("--state-path", required=True)
    wj.add_argument("--window-size", type=int, default=WINDOW_SIZE_MS)
    wj.add_argument("--window-cleanup-delay", type=int, default=CLEANUP_DELAY_MS)
    wj.add_argument("--checkpoint", type=int, default=CHECKPOINT_MS)
    wj.add_argument("--late", default="refire", choices=["refire", "drop"])
    wj.add_argument("--partitions", type=int, default=DEFAULT_PARTITIONS)
    wj.add_argument("--event-time-column")
    wj.add_argument("--available-now", action="store_true")
    qc = sub.add_parser("query")
    qc.add_argument("--state-path", required=True)
    qc.add_argument("--requests", required=True, help="text file, one request per line")
    qc.add_argument("--window-size", type=int, default=WINDOW_SIZE_MS)
    qc.add_argument("--window-cleanup-delay", type=int, default=CLEANUP_DELAY_MS)
    qc.add_argument("--late", default="refire", choices=["refire", "drop"])
    qc.add_argument("--now", type=int)
    qc.add_argument("--output", required=True)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.cmd == "window":
        source, sink = sources(spark, args, ap)
        q = start_window_job(spark, source, args.sink_path, args.state_path, args.window_size,
                             args.window_cleanup_delay, args.checkpoint, args.late, args.partitions,
                             args.event_time_column, args.available_now, sink=sink)
        q.awaitTermination()
        return
    lines = request_tokens(read_request_lines(spark, args.requests))
    ans = answer_requests(spark, lines, args.state_path, args.window_size, args.window_cleanup_delay, args.now,
                          args.late)
    ans.write.mode("overwrite").parquet(args.output)


def sources(spark: SparkSession, args: argparse.Namespace, ap: argparse.ArgumentParser):
    """(streaming source, sink function or None) of the window program's options."""
    if not args.source_path and not (args.brokers and args.source):
        ap.error("give --source-path, or --brokers and --source")
    if not args.sink_path and not (args.brokers and args.sink):
        ap.error("give --sink-path, or --brokers and --sink")
    if args.source_path:
        source = key_source(spark, args.source_path, args.source_format)
    else:
        source = kafka_key_reader(spark, args.brokers, args.source).load()
    sink = (lambda pairs, _batch: kafka_sink(pairs, args.brokers, args.sink).save()) if args.sink else None
    return source, sink


if __name__ == "__main__":
    main()
