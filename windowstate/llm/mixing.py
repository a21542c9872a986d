"""Mixing sources to target weights by pivotal dependent rounding.

Sources, in code point order with null last, take turns at the weights and share 100 % of all words; no target is
above `cap` times its source, the excess is shared out again by weight. A document's expected copies are its
source's target over its size: the whole part is taken for sure, the fraction is a copy probability. Two fractions
of one source meet and words move from one to the other, in a random direction, until one of them is 0 or 1; this
leaves expected copies unchanged and keeps the sum of words exactly. Documents meet within chunks of a source, each
chunk leaves at most one fraction, and the fractions that are left meet in the next level of a tree; a source's last
one goes to its nearer whole number, so a source misses its target by half a document at most.

A hot source is many chunks, so no task grows with it. Randomness comes from seeds and ids: reruns agree.

Edge cases: null text has size 0; a source without words has target 0; documents of size 0 are taken at their whole
part only (they hold no words); rows equal in doc_id, source and text are one unit and get equal copies; a null
source is a source; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import n_space_words, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 20240229
CHUNK = 8192     # documents that meet in one task, and the fan-in of the tree


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, words, n) -> (rank, source, words, n, target). `sources` has one row per source; ranks come from a
    distributed sort, and the common level of the uncapped targets from repeated sums."""
    spark = sources.sparkSession
    ranked = spark.createDataFrame(
        sources.select("source", "words", "n").sort(F.asc_nulls_last("source")).rdd.zipWithIndex()
        .map(lambda x: (x[1], x[0]["source"], x[0]["words"], x[0]["n"])),
        "rank long, source string, words long, n long")
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    s = table(ranked.withColumn("w", by_rank).withColumn("most", F.col("words") * F.lit(float(cap))), "mix-sources")
    level, n_capped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) >= F.col("most")
        got = s.agg(F.sum("words").alias("total"), F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("fixed"),
                    F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("open"),
                    F.sum(over.cast("long")).alias("capped")).first()
        if not got.total or got.capped == n_capped or not got.open:
            break
        n_capped, level = got.capped, (got.total - got.fixed) / got.open
    return s.select("rank", "source", "words", "n", F.least(F.col("most"), F.col("w") * F.lit(level)).alias("target"))


def _meet(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivot the fractions `p` of documents of `size` words one after the other; at most one stays a fraction."""
    p, size, draws = p.tolist(), size.tolist(), rng.random(len(p)).tolist()
    i = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        held, new = p[i] * size[i], p[j] * size[j]
        up = min(size[i] - held, new)          # words i can gain from j
        down = min(held, size[j] - new)        # words i can give to j
        gain = up if draws[j] * (up + down) < down else -down
        p[i], p[j] = (held + gain) / size[i], (new - gain) / size[j]
        for k, full in ((i, held + gain >= size[i] * (1 - 1e-12)), (j, new - gain >= size[j] * (1 - 1e-12))):
            p[k] = 1.0 if full else 0.0 if p[k] < 1e-12 else p[k]
        i = j if not 0.0 < p[i] < 1.0 else i
        if not 0.0 < p[i] < 1.0:
            i = -1
    return np.array(p)


def _level(units: DataFrame, level: int, chunks: str, seed: int) -> DataFrame:
    """One level of the tree: units (uid, rank, size, p) meet within (rank, chunk)."""
    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "uid"], ascending=[False, True], kind="stable")
        rng = np.random.Generator(np.random.Philox(key=[seed + level, int(group["rank"].iloc[0]) * 1_000_003
                                                        + int(group["chunk"].iloc[0])]))
        group["p"] = _meet(group["size"].to_numpy(dtype=float), group["p"].to_numpy(dtype=float), rng)
        return group[["uid", "rank", "size", "p"]]

    dealt = units.withColumn("chunk", F.pmod(F.xxhash64("uid", F.lit(seed), F.lit(level)), F.expr(chunks)))
    return dealt.groupBy("rank", "chunk").applyInPandas(meet, "uid string, rank long, size long, p double")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """All columns of `docs` (which holds doc_id, source and text) plus __size, __source_size (long), __target
    (double) and __copies (int)."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    rows = table(docs.select(key.alias("key"), "source", n_space_words(F.col("text")).alias("size")), "mix-rows")
    units = rows.groupBy("key", "source").agg(F.max("size").alias("one"), F.sum("size").alias("size"))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")),
                             weights, cap)
    sources = table(sources, "mix-targets")
    s = sources.select(F.col("source").alias("s"), "rank", F.col("words"), "n", "target")
    share = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    units = (units.join(s, F.col("source").eqNullSafe(F.col("s")))
             .select(F.concat_ws("|", "key", F.col("rank").cast("string")).alias("uid"), "key", "source", "rank", "n",
                     "size", "words", "target", F.floor(share).cast("int").alias("whole"),
                     F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0).alias("p")))
    units = table(units, "mix-units")
    open_units = units.where("p > 0").select("uid", "rank", "size", "p", "n")
    chunks, settled, level = f"cast(ceil(n / {chunk}) as long)", [], 0
    while True:
        done = table(_level(open_units, level, chunks, seed), f"mix-level{level}")
        left = done.where("p > 0 and p < 1")
        settled.append(done.where("p = 0 or p = 1"))
        per_source = left.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
        most = per_source.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            settled.append(left.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
            break
        open_units = left.join(per_source, "rank").select("uid", "rank", "size", "p", "n")
        level += 1
    extra = settled[0]
    for part in settled[1:]:
        extra = extra.unionByName(part)
    copies = (units.join(extra.select("uid", F.col("p").cast("int").alias("extra")), "uid", "left")
              .select(F.col("key").alias("__key"), F.col("source").alias("__src"), F.col("words").alias("__source_size"),
                      F.col("target").alias("__target"),
                      (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("__copies")))
    return (docs.withColumn("__k", key).withColumn("__size", n_space_words(F.col("text")))
            .join(copies, (F.col("__k") == F.col("__key")) & F.col("source").eqNullSafe(F.col("__src")), "left")
            .select(*docs.columns, "__size", "__source_size", "__target", "__copies"))
