"""Deterministic replay of a table through a file stream.

Rows carry an arrival batch `b`. One job writes the rows of all batches, each as `files_per_batch` files dealt out over
the tasks, and the files get the batch's arrival time, 1000*b ms, as their modification time, which is what a file stream
reads by. Then one streaming query with availableNow reads them, that number of files per trigger: each arrival batch is
one micro-batch, and a last no-data batch closes what the last watermark passed. All folders live under the session's
checkpoint folder.

The number of arrival batches is a parameter of the replay; the number of files grows with the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windowstate.session import scratch_dir

ROWS_PER_FILE = 250_000


@dataclass
class ReplayRun:
    root: str
    input_dir: str
    checkpoint: str
    output: str
    schema: str
    files_per_batch: int | None = None


def new_run(spark: SparkSession, tag: str, schema: str, files_per_batch: int | None = None) -> ReplayRun:
    """`files_per_batch`: None takes it from the rows, one for each ROWS_PER_FILE of a batch."""
    root = scratch_dir(spark, tag)
    return ReplayRun(root, f"{root}/input", f"{root}/checkpoint", f"{root}/output", schema, files_per_batch)


def feed(rows: DataFrame, run: ReplayRun, batches: list[int], batch_col: str = "b") -> None:
    """Write the rows of arrival batches as the stream's next files. Every batch is `files_per_batch` files (a batch of
    fewer rows would break the order, so it is an error)."""
    spark, n = rows.sparkSession, run.files_per_batch or 1
    b = F.col(batch_col)
    slot = F.pmod(F.monotonically_increasing_id(), F.lit(n))         # row by row, whatever the rows hold
    part = (rows.where(b.between(min(batches), max(batches)))
            .repartitionById(n * len(batches), ((b - min(batches)) * n + slot).cast("int")))
    part.write.partitionBy(batch_col).mode("append").parquet(run.input_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(run.input_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    for batch in batches:
        files = [f for f in fs.globStatus(path(f"{run.input_dir}/{batch_col}={batch}/part-*")) or []]
        if len(files) != n:
            raise ValueError(f"arrival batch {batch} has fewer rows than files_per_batch")
        for f in files:
            fs.setTimes(f.getPath(), 1000 * batch, -1)


def input_stream(spark: SparkSession, run: ReplayRun) -> DataFrame:
    return (spark.readStream.schema(run.schema).option("maxFilesPerTrigger", run.files_per_batch or 1)
            .parquet(f"{run.input_dir}/*"))


def replay(spark: SparkSession, rows: DataFrame, run: ReplayRun,
           start: Callable[[DataFrame, ReplayRun], StreamingQuery], batches: int,
           split: int | None = None, batch_col: str = "b", first: int = 0) -> ReplayRun:
    """Feed arrival batches first..batches-1 and run one query over them; with `split`, batches up to it come first and
    a second query resumes from the checkpoint for the rest. An arrival batch's streaming batch id is its number less
    `first` (one more after the split, whose first run ends with a no-data batch)."""
    numbers = list(range(first, batches))
    if run.files_per_batch is None:
        run.files_per_batch = max(1, rows.count() // (batches * ROWS_PER_FILE))
    groups = [numbers] if split is None else [numbers[:split + 1], numbers[split + 1:]]
    for group in groups:
        feed(rows, run, group, batch_col)
        q = start(input_stream(spark, run), run)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return run
