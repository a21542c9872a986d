"""Line dedup over overlapping windows of three lines.

Lines are split at line feeds. Every window of three consecutive lines is hashed; for each hash the first place
(document id, then position; null ids last) is kept and every later place marks its three lines. Marks of
overlapping windows are merged per document and the marked lines go.

With `sentences`, lines are cut further at sentence ends (a space after . ! or ?), so that passages inside long lines
are found, too; units are compared without the line feed or space that ends them, and what is kept keeps its own.

Edge cases: documents of fewer than three lines have no window and stay; null text stays null (0 lines); windows
of blank lines only are no windows, so paragraph breaks do not match; rows equal in doc_id and text count as one
document and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import let

WINDOW_LINES = 3
UNIT_END = r"(?<=\n)|(?<=[.!?] )"                   # no characters: a unit keeps what ends it


def _units(sentences: bool) -> Column:
    """Lines without their line feeds, or sentences with what ends them; null for null text."""
    return F.split("text", UNIT_END if sentences else "\n")


def marked_lines(docs: DataFrame, window: int = WINDOW_LINES, sentences: bool = False) -> DataFrame:
    """(doc_id, fp, lines): sorted 0-based positions of the lines to remove, per distinct (doc_id, text hash)."""
    lines = F.transform(_units(True), lambda x: F.regexp_replace(x, r"[\n ]\z", "")) if sentences else _units(False)
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(r"[\n ]") if sentences
                                               else F.col("text").contains("\n")).select(
        "doc_id", F.xxhash64("text").alias("fp"), lines.alias("lines"))
    windows = rows.where(F.size("lines") >= window).select("doc_id", "fp", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("lines") - (window - 1)),
        lambda i: F.concat_ws("\n", F.slice(F.col("lines"), i, F.lit(window))))).alias("pos", "window_text"))
    places = (windows.where(F.col("window_text").rlike(r"\S"))
              .select("doc_id", "fp", "pos", F.unhex(F.md5("window_text")).alias("h")))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp", "pos")
    firsts = places.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = places.join(firsts, "h").where(place > F.col("first"))
    return (later.select("doc_id", "fp", F.explode(F.sequence(F.col("pos"), F.col("pos") + window - 1)).alias("line"))
            .groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("line")).alias("marked")))


def _kept(lines: Column, marked: Column) -> Column:
    """The lines whose 0-based positions are not in the sorted array `marked`: positions are merged to ranges, and the
    slices between them joined, so a document of many marked lines takes linear time."""
    first = F.filter(marked, lambda p, i: (i == 0) | (F.get(marked, i - 1) < p - 1))
    last = F.filter(marked, lambda p, i: (i == F.size(marked) - 1) | (F.get(marked, i + 1) > p + 1))

    def slices(r: Column) -> Column:
        """The slice before each range, and what follows the last."""
        after = lambda i: F.coalesce(F.get(r["last"], i - 1) + 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.size(r["first"])), lambda i: F.slice(
            lines, after(i) + 1, F.coalesce(F.get(r["first"], i), F.size(lines)) - after(i)))

    return F.flatten(let(F.struct(first.alias("first"), last.alias("last")), slices))


def dedup_lines(docs: DataFrame, window: int = WINDOW_LINES, sentences: bool = False) -> DataFrame:
    """All columns of `docs` with `text` rid of repeated windows, plus __n_lines and __n_removed (long)."""
    marks = marked_lines(docs, window, sentences).select(F.col("doc_id").alias("__m_id"), F.col("fp").alias("__m_fp"), "marked")
    joined = docs.withColumn("__fp", F.xxhash64("text")).join(
        marks.withColumnRenamed("marked", "__marked"),
        F.col("doc_id").eqNullSafe(F.col("__m_id")) & (F.col("__fp") == F.col("__m_fp")), "left")
    lines = _units(sentences)
    kept = F.array_join(let(lines, lambda x: _kept(x, F.col("__marked"))), "" if sentences else "\n")
    if sentences:                                      # nothing follows the end of the last unit that is kept
        kept = F.when(F.array_contains("__marked", F.size(lines) - 1), F.regexp_replace(kept, r"[\n ]\z", "")).otherwise(kept)
    out = joined.withColumn("__n_lines", F.coalesce(F.size(lines).cast("long"), F.lit(0).cast("long")))
    out = out.withColumn("__n_removed", F.coalesce(F.size("__marked").cast("long"), F.lit(0).cast("long")))
    return out.withColumn("text", F.when(F.col("__marked").isNotNull(), kept).otherwise(F.col("text"))).select(
        *docs.columns, "__n_lines", "__n_removed")
