"""Exact dedup: documents grouped by a 128-bit content hash, the smallest id of a group stays, bytes exclude collisions.

Texts are compared after every run of ASCII white space has become one space.

1. Each row gives its id, its hash and a row number; these narrow rows are grouped by hash (partial aggregates first),
   for the smallest id and the size.
2. The bytes: distinct (hash, text) pairs are counted by hash. A copy meets its like on the map side, so a group of any
   size sends one text per map task. One pair for a hash means that all rows of the group are the same bytes.
3. Rows of a hash with several texts are grouped again, by hash and text. With md5 that takes texts made for it.

Only DataFrame functions run. Edge cases: null counts as empty text; null ids come last, so they stay only where a
group has no other; of several rows with the id that stays exactly one is `kept`; an empty table gives an empty
result; other columns are ignored by `exact_groups` and kept by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import table

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(body: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(body))


def _members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what its group of `keys` keeps. Hot groups are aggregated per task before they are shuffled; the
    join back is of narrow rows, which AQE splits where one group fills a task."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("first")
    groups = rows.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, keys).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"),
        *keys)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs` (which holds doc_id and text)."""
    body = normalised(F.col("text"))
    pairs = docs.select("doc_id", body.alias("body"), digest(body).alias("digest"))
    number = F.monotonically_increasing_id().alias("row")
    rows = table(pairs.select("doc_id", "digest", number), "exact-rows")
    sha = F.sha2("body", 256)
    hashes = table(pairs.select("digest", "body").distinct().select("digest", sha.alias("text_sha256"))
                   .groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("text_sha256").alias("text_sha256")),
                   "exact-hashes")
    clash = hashes.where("texts > 1").select("digest")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    plain = _members(rows, ["digest"]).join(hashes.where("texts = 1"), "digest").select(*out)
    if not clash.limit(1).count():
        return plain
    apart = table(pairs.join(clash, "digest", "left_semi").select("doc_id", "digest", "body", number), "exact-clash")
    return plain.unionByName(_members(apart, ["digest", "body"]).withColumn("text_sha256", sha).select(*out))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one per group of equal texts."""
    kept = exact_groups(docs.select("doc_id", "text")).where("kept").select(
        F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    sha = docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    rows = sha.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha")),
                    "left_semi")
    return rows.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)
