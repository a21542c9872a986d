"""Benchmark decontamination: a prefix-filtered set join that verifies exact windows.

Each benchmark item gives windows of `window` consecutive words (a shorter item is one window). A document holds a
window only if it holds every word of it, so one prefix token is enough to find it: the window's rarest word, by
its count over all documents. Document words join the windows filed under them; the positional bound keeps those
where the window fits around the word, and comparing the document's slice with the window verifies it exactly.
All of it is DataFrame operations.

Edge cases: null or wordless texts have no words, windows or hits; repeated items share windows but count by
item_id; rows of one doc_id are told apart by their text's hash, equal rows get equal results; empty tables work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import alnum_words, table

WINDOW_WORDS = 10
# Broadcast the window table only if it has at most this many rows (counted); beyond that it joins by shuffles.
BROADCAST_WINDOWS = 100_000


def item_windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, words): every window of every item."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (words.select("item_id", F.explode(F.transform(
        starts, lambda i: F.slice(F.col("w"), i, F.lit(window)))).alias("words")).distinct())


def prefix_windows(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(token, back, words): each distinct window under its rarest word; `back` is that word's place in it. Words
    are counted over all documents, only those of the benchmark."""
    vocab = windows.select(F.explode("words").alias("token")).distinct()
    tokens = docs.select(F.explode(alnum_words(F.col("text"))).alias("token"))
    counts = (tokens.join(F.broadcast(vocab) if small else vocab, "token").groupBy("token")
              .agg(F.count(F.lit(1)).alias("n")))
    places = windows.select("words").distinct().select("words", F.posexplode("words").alias("back", "token"))
    return (places.join(counts, "token").groupBy("words")
            .agg(F.min(F.struct("n", "token", "back")).alias("m"), F.count(F.lit(1)).alias("known"))
            .where(F.col("known") == F.size("words"))    # a word that no document has: no document has the window
            .select(F.col("m.token").alias("token"), F.col("m.back").alias("back"), "words"))


def window_hits(docs: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, fp, start, words): every occurrence of a distinct window; start counts words from 0."""
    small = windows.count() <= broadcast_rows
    filed = table(prefix_windows(docs, windows, small), "decontam-prefix")
    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), alnum_words(F.col("text")).alias("w"))
    start = F.col("pos") - F.col("back")
    fits = (start >= 0) & (start + F.size("words") <= F.size("w"))
    same = F.slice(F.col("w"), F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")
    if small:
        near = rows.select("doc_id", "fp", "w", F.posexplode("w").alias("pos", "token")).join(F.broadcast(filed), "token")
    else:
        near = (rows.select("doc_id", "fp", F.posexplode("w").alias("pos", "token")).join(filed, "token")
                .select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "pos", "back", "words")
                .join(rows.dropDuplicates(["doc_id", "fp"]),
                      F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("f") == F.col("fp"))))
    return near.where(fits).where(same).select("doc_id", "fp", start.alias("start"), "words").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                  broadcast_rows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, fp, n_hit, item_ids): per distinct (doc_id, text hash) with any window, its hit words and the sorted
    ids (as strings) of items with occurring windows."""
    windows = table(item_windows(items, window), "decontam-windows")
    hits = table(window_hits(docs, windows, broadcast_rows), "decontam-hits")
    covered = (hits.select("doc_id", "fp", F.explode(F.sequence(F.col("start"), F.col("start") + F.size("words") - 1))
                           .alias("word")).distinct().groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n_hit")))
    # the item names of a window are looked up per window that occurs at all, then per document
    found = (hits.select("doc_id", "fp", "words").distinct().join(windows, "words")
             .groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
                                          F.count_distinct("item_id").alias("n_items")))
    return covered.join(found.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "item_ids", "n_items"),
                        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))).drop("d", "f")


def flag_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                      broadcast_rows: int = BROADCAST_WINDOWS) -> DataFrame:
    """All columns of `docs` plus __n_hit, __n_items (long) and __item_ids (sorted strings)."""
    marks = contamination(docs.select("doc_id", "text"), items, window, broadcast_rows).select(
        F.col("doc_id").alias("__d"), F.col("fp").alias("__f"), F.col("n_hit").alias("__h"),
        F.col("n_items").alias("__i"), F.col("item_ids").alias("__ids"))
    zero = F.lit(0).cast("long")
    joined = docs.withColumn("__fp", F.xxhash64("text")).join(
        marks, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__fp") == F.col("__f")), "left")
    return (joined.withColumn("__n_hit", F.coalesce("__h", zero)).withColumn("__n_items", F.coalesce("__i", zero))
            .withColumn("__item_ids", F.coalesce("__ids", F.array().cast("array<string>")))
            .select(*docs.columns, "__n_hit", "__n_items", "__item_ids"))
