"""Distributed ordered scans: running max, and "first mark after a point".

Rows are dealt into chunks by an explicit function of their order column: boundaries are quantiles, computed once
and then fixed, so every use of a frame sees the same chunks. Each chunk is scanned by a window partitioned by
chunk, in linear time; the carry between chunks is a scan over one row per chunk. One chunk is one such case, not
another path."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowstate.session import scratch_dir

# Rows that one task scans; the chunk count follows from the counted rows.
ROWS_PER_CHUNK = 200_000
# Relative error of the quantiles that bound the chunks (sizes differ by that share of all rows at most).
QUANTILE_ERROR = 0.001


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """A derived table written once to the shared scratch folder, so later steps do not re-run what is upstream."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """(the written table, its row count)."""
    out = write_table(df, tag)
    return out, out.count()


def with_chunk(df: DataFrame, order_col: str, n_rows: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `__chunk`, increasing with `order_col`; rows of one order value share a chunk."""
    n = max(1, math.ceil(n_rows / rows_per_chunk))
    at = F.col(order_col).cast("double")      # keeps the order; values that become equal share a chunk
    bounds = []
    if n > 1:
        bounds = df.select(at.alias("__o")).approxQuantile("__o", [i / n for i in range(1, n)], QUANTILE_ERROR)
    bounds = sorted(set(bounds))
    if not bounds:
        return df.withColumn("__chunk", F.lit(0.0))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__o", outputCol="__chunk")
    return cut.transform(df.withColumn("__o", at)).drop("__o")


def running_max(df: DataFrame, order_col: str, value_col: str, out_col: str, n_rows: int | None = None,
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """out = max(value) over rows with order <= this row's order (order values distinct). `df` is read several
    times: pass a materialized table."""
    r = with_chunk(df, order_col, df.count() if n_rows is None else n_rows, rows_per_chunk)
    inside = Window.partitionBy("__chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (r.groupBy("__chunk").agg(F.max(value_col).alias("__cmax"))
             .withColumn("__before", F.max("__cmax").over(
                 Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)))
             .select("__chunk", "__before"))                      # one row per chunk
    return (r.withColumn("__in", F.max(value_col).over(inside)).join(F.broadcast(carry), "__chunk", "left")
            .withColumn(out_col, F.greatest(F.col("__in"), F.col("__before")))
            .drop("__chunk", "__in", "__before"))


def first_mark_after(points: DataFrame, point_col: str, marks: DataFrame, mark_col: str, value_col: str,
                     out_col: str, strict: bool = True, n_rows: int | None = None,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """As-of forward lookup: for each distinct point p, min(value) over marks with mark > p (mark >= p if not
    strict); null if none. Points and marks are merged into one ordering; nothing is paired. Both are read several
    times: pass materialized tables. `n_rows` is their counted total."""
    vtype = marks.schema[value_col].dataType
    # scanned from large to small: at equal keys a mark comes before the point when it counts (>=), else after it
    point_kind, mark_kind = (1, 0) if strict else (0, 1)
    u = (points.select(F.col(point_col).cast("bigint").alias("__k")).distinct()
         .select("__k", F.lit(point_kind).alias("__kind"), F.lit(None).cast(vtype).alias("__v"))
         .unionByName(marks.groupBy(F.col(mark_col).cast("bigint").alias("__k")).agg(F.min(value_col).alias("__v"))
                      .select("__k", F.lit(mark_kind).alias("__kind"), "__v")))
    u = with_chunk(u, "__k", points.count() + marks.count() if n_rows is None else n_rows, rows_per_chunk)
    inside = (Window.partitionBy("__chunk").orderBy(F.desc("__k"), F.desc("__kind"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = (u.groupBy("__chunk").agg(F.min("__v").alias("__cmin"))
             .withColumn("__after", F.min("__cmin").over(
                 Window.orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)))
             .select("__chunk", "__after"))                       # one row per chunk
    return (u.withColumn("__in", F.min("__v").over(inside)).filter(F.col("__kind") == point_kind)
            .join(F.broadcast(carry), "__chunk", "left")
            .select(F.col("__k").alias(point_col), F.coalesce("__in", "__after").alias(out_col)))


def col_or_lit(x: Column | int | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")
