"""Shared pieces: derived tables on the shared folder, word columns, row keys."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowstate.session import scratch_dir

ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # runs of 0-9, a-z and non-ASCII characters (after ascii_lower)
NO_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # what stands between those words
SPACE_WORD = r"[^\x20\x09-\x0D]+"                  # runs without ASCII white space


def table(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once as Parquet under spark.checkpoint.dir and read back: cuts the lineage, survives lost
    executors, and later steps read only the columns they need."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is (`lower` alone would fold É, too)."""
    return (F.when(F.octet_length(col) == F.char_length(col), F.lower(col))
            .otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase)))


def alnum_words(col: Column) -> Column:
    """Words of the contract's class in lower case, in order; null has none. By splitting: extracting each match took
    ten times as long."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), NO_ALNUM), "")


def let(value: Column, use) -> Column:
    """use(value) with `value` computed once: inside a lambda function a plain expression would be computed again for
    each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_space_words(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def rows_of(spark, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table from Python values, as plain literals."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def numbered(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """`df` (a stored table) with `__at`, each row's place from 0 in `order`, which must tell all rows apart. Rows are
    dealt out by ranges of the order, so no task holds more than its range, whatever key repeats; only one number per
    range is added up in one place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = table(ranged.withColumn("__id", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__id", 33)                      # partition number above, row number in the lower 33 bits
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = (ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
             .select("__part", F.coalesce(before, F.lit(0)).alias("__before")))
    return (ranged.withColumn("__part", part).join(F.broadcast(parts), "__part")
            .withColumn("__at", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__id", "__part", "__before"))
