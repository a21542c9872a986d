"""Lookup request text.

A request token is `key` (time = now), `time,key`, or a command. Parsing follows the reference client:
the token is lower-cased; 'stop' / 'quit' are commands (a prompt ends there; in a table of requests
they ask for nothing); the token is split on ',' with trailing empty
parts removed (so ',' has zero parts); one part -> (now, key); two parts -> (time, key); zero or three+ parts
are still sent, as (-1, -1); a part that is not a strict decimal long makes the request invalid (not sent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.functions.codec import parse_long

# ---- fixed values: client commands and the placeholder of a request with too many parts ----
STOP_WORDS = ("stop", "quit")
UNSET = -1
# ------------------------------------------------------------------------------------------------


def parse_request(line: Column | str, now_ms: Column | int) -> Column:
    """struct<command string, ts_ms bigint, key bigint>; command is 'lookup', 'stop' or 'invalid'."""
    raw = F.col(line) if isinstance(line, str) else line
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("bigint")
    tok = F.lower(raw)
    trimmed = F.regexp_replace(tok, r",+\z", "")
    parts = F.split(trimmed, ",")
    n_parts = F.when(tok == F.lit(""), F.lit(1)).when(trimmed == F.lit(""), F.lit(0)).otherwise(F.size(parts))
    p0 = parse_long(F.element_at(parts, 1), invalid=None)
    p1 = parse_long(F.element_at(parts, 2), invalid=None)
    unset = F.lit(UNSET).cast("bigint")
    is_stop = tok.isin(*STOP_WORDS)
    ts = (F.when(is_stop, F.lit(None)).when(n_parts == 1, now).when(n_parts == 2, p0).otherwise(unset))
    key = (F.when(is_stop, F.lit(None)).when(n_parts == 1, p0).when(n_parts == 2, p1).otherwise(unset))
    ok = F.when(n_parts == 1, p0.isNotNull()).when(n_parts == 2, p0.isNotNull() & p1.isNotNull()).otherwise(True)
    command = F.when(raw.isNull(), "invalid").when(is_stop, "stop").when(ok, "lookup").otherwise("invalid")
    return F.struct(
        command.alias("command"),
        F.when(command == "lookup", ts).cast("bigint").alias("ts_ms"),
        F.when(command == "lookup", key).cast("bigint").alias("key"),
    )


def request_tokens(lines: DataFrame, line_col: str = "line", order_col: str = "line_id") -> DataFrame:
    """Split request lines into whitespace-separated tokens, as the reference client reads them (`1000, 7` is two
    requests: `1000,` then `7`). Returns `(req_id, line)`; req_id is the struct (line id, position), which orders
    tokens by line, then place, for line ids of any type and size."""
    toks = lines.select(F.col(order_col), F.posexplode(F.split(F.trim(F.col(line_col)), r"\s+")).alias("pos", "tok"))
    return toks.filter(F.col("tok") != "").select(
        F.struct(F.col(order_col).alias("line_id"), "pos").alias("req_id"), F.col("tok").alias("line"))


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(line_id, line)` of text files; line_id is the struct (file, start of the split, row of the split), which
    follows the order of lines in each file however files are packed into partitions."""
    return spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("row")).alias("line_id"), F.col("value").alias("line"))
