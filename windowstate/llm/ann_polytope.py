"""Approximate nearest neighbours by cross-polytope hashing.

A rotation is a fast pseudo-rotation (random signs and a Hadamard transform, three times); the nearest signed axis of a
turned unit vector is one section of its hash. A table's hash joins as many sections as give one bucket for each
`BUCKET_ROWS` rows, the last section over the first few axes only, so buckets grow with the table and stay small. A query
probes, in each table, the buckets of the smallest total distance: the squared gaps between its coordinate on a bucket's
axis and its largest one, added over the sections. The number of probes follows one rule at every size, `BASE_PROBES`
plus the number of buckets to the power `PROBES_POWER`, so the share of rows that a query meets falls as the table grows
(a few hundred rows are all met). Candidates are reranked exactly by the cosine of the original vectors, in double
precision. The whole table is indexed; the query set is stated by the caller.

Rows are dealt out by the first sections of their hash, a group for `ROWS_BLOCK` rows; a query goes once to each group in
which it probes anything, with its list of buckets there, and only the rows of those are compared.

Equal vectors are one class, searched once; of its ids only the k + 1 smallest can be among anyone's k nearest (ties
go to the smaller id, and a query leaves itself out), so a vector that fills the table makes no large group. A group
is dealt out in blocks of rows by blocks of queries, whatever its size. A query that finds fewer than k neighbours is
searched again against all rows, in blocks.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows without vec_id, take no part;
vectors are compared with those of their own length only; fewer than k candidates are all returned; rows of one
vec_id never answer each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from windowstate.llm.common import table

TABLES = 8
BUCKET_ROWS = 2
BASE_PROBES = 128
PROBES_POWER = 0.6
ROWS_BLOCK = 8192
PROBES_BLOCK = 2048
NEAR_TIE = 1e-12
SEED = 5


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (width a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """The rows at unit length, zero-padded to a power of two."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    unit = np.zeros((len(vectors), width))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit[:, :vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return unit


def turned(unit: np.ndarray, tab: int, section: int) -> np.ndarray:
    """The rows under the pseudo-rotation of a table's section."""
    width = unit.shape[1]
    rng = np.random.default_rng([SEED, tab, section, width])
    for _ in range(3):
        unit = _hadamard(unit * rng.choice([-1.0, 1.0], width))
    return unit


def sections(rows: int, width: int) -> list[int]:
    """How many coordinates each section of a hash takes (it has twice as many axes): buckets for `rows` rows."""
    bits = max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))
    full = width.bit_length()                               # a section over all coordinates has 2 * width axes
    return [width] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])


def n_probes(dims: list[int]) -> int:
    buckets = math.prod(2 * d for d in dims)
    return min(buckets, BASE_PROBES + math.ceil(buckets ** PROBES_POWER))


def group_base(rows: int, dims: list[int]) -> int:
    """What divides a hash into its group (the first sections, one group for ROWS_BLOCK rows) and the bucket in it."""
    groups, at = 1, 0
    while groups * ROWS_BLOCK < rows and at < len(dims):
        groups *= 2 * dims[at]
        at += 1
    return math.prod(2 * d for d in dims[at:])


def _axes(unit: np.ndarray, tab: int, dims: list[int]) -> list[np.ndarray]:
    """For each section the rows' coordinates on its signed axes."""
    out = []
    for j, d in enumerate(dims):
        part = turned(unit, tab, j)[:, :d]
        out.append(np.concatenate((part, -part), axis=1))
    return out


def hashes(axes: list[np.ndarray], n: int) -> np.ndarray:
    code = np.zeros(n, dtype=np.int64)
    for a in axes:
        code = code * a.shape[1] + a.argmax(axis=1)
    return code


def probed(gaps: list[np.ndarray], probes: int) -> np.ndarray:
    """The `probes` hashes of smallest total gap. Gaps only add up, so no more than `probes` beginnings are kept."""
    codes, cost = np.zeros(1, dtype=np.int64), np.zeros(1)
    for g in gaps:
        codes = (codes[:, None] * len(g) + np.arange(len(g))).ravel()
        cost = (cost[:, None] + g).ravel()
        if len(cost) > probes:
            least = np.argpartition(cost, probes - 1)[:probes]
            codes, cost = codes[least], cost[least]
    return np.sort(codes)


def _matrix(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1).astype(float)


def _filed(classes: DataFrame, dtype: str, tables: int, rows: int) -> DataFrame:
    """(dim, tab, bucket, code, id, first_id, vec): each class under its hash, as group (bucket) and code in it."""
    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=False):
                unit = unit_rows(_matrix(part["vec"], dtype))
                dims = sections(rows, unit.shape[1])
                base = group_base(rows, dims)
                for t in range(tables):
                    code = hashes(_axes(unit, t, dims), len(unit))
                    yield pd.DataFrame({"dim": dim, "tab": t, "bucket": code // base, "code": code % base,
                                        "id": part["id"].to_numpy(), "first_id": part["first_id"].to_numpy(),
                                        "vec": part["vec"].to_numpy()})

    return classes.select("dim", "id", "first_id", "vec").mapInPandas(
        run, "dim int, tab int, bucket long, code long, id long, first_id long, vec binary")


def _probing(asked: DataFrame, dtype: str, tables: int, rows: int, probes: int | None) -> DataFrame:
    """(dim, tab, bucket, id, vec, codes): each asking class once for each group it probes, with its codes there."""
    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=False):
                unit = unit_rows(_matrix(part["vec"], dtype))
                dims = sections(rows, unit.shape[1])
                base, n = group_base(rows, dims), probes or n_probes(dims)
                for t in range(tables):
                    axes = _axes(unit, t, dims)
                    out = []
                    for i, (id_, vec) in enumerate(zip(part["id"], part["vec"], strict=True)):
                        codes = probed([(a[i].max() - a[i]) ** 2 for a in axes], n)
                        groups, first = np.unique(codes // base, return_index=True)
                        out += [(dim, t, g, id_, vec, c.tobytes()) for g, c in
                                zip(groups.tolist(), np.split(codes % base, first[1:]), strict=True)]
                    yield pd.DataFrame(out, columns=["dim", "tab", "bucket", "id", "vec", "codes"])

    return asked.select("dim", "id", "vec").mapInPandas(
        run, "dim int, tab int, bucket long, id long, vec binary, codes binary")


def _rerank(index: DataFrame, asked: DataFrame, dtype: str, keep: int) -> DataFrame:
    """(q, id, score): for each group (bucket) the `keep` nearest classes that every probing class meets there, ties to
    the smaller first_id. Both sides are dealt out in blocks of their group; a block of rows meets each block of
    queries."""
    where = ["dim", "tab", "bucket"]
    sizes = (index.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / ROWS_BLOCK).cast("int").alias("nr"))
             .join(asked.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / PROBES_BLOCK).cast("int").alias("nq")), where))
    sizes = table(sizes, "ann-sizes")        # a row per bucket
    rows = (index.join(sizes, where).withColumn("r", F.pmod(F.xxhash64("id"), F.col("nr")).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))))
    asks = (asked.join(sizes, where).withColumn("q", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int"))
            .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))))
    block = [*where, "r", "q"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return nearest(_matrix(left["vec"], dtype), left["id"].to_numpy(), _matrix(right["vec"], dtype),
                       right["id"].to_numpy(), keep, left["first_id"].to_numpy(), left["code"].to_numpy(),
                       [np.frombuffer(c, dtype=np.int64) for c in right["codes"]])

    return (rows.select(*block, "code", "id", "first_id", "vec").groupBy(*block)
            .cogroup(asks.select(*block, "id", "vec", "codes").groupBy(*block))
            .applyInPandas(score, "q long, id long, score double"))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of matching rows; a pair gives the same double wherever it is computed. Rows are scaled by powers of
    two first, which is exact, so that squares neither overflow nor vanish."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]) for v in (x, y))
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))


def nearest(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, keep: int,
            first: np.ndarray, code: np.ndarray, probes: list[np.ndarray]) -> pd.DataFrame:
    """The `keep` rows of largest cosine among those whose code an asked vector probes, ties to the smaller `first` id
    of a row's class."""
    unit = [v / np.abs(v).max(axis=1, keepdims=True) for v in (rows, asked)]
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in unit]
    order = np.argsort(code, kind="stable")
    known, start = np.unique(code[order], return_index=True)
    runs = np.split(order, start[1:])                       # rows of each code that occurs
    got = []
    for i, wanted in enumerate(probes):
        here = np.flatnonzero(np.isin(known, wanted))
        if not len(here):
            continue
        met = order if len(here) == len(known) else np.concatenate([runs[j] for j in here])
        rough = unit[0][met] @ unit[1][i]
        if len(met) > keep:
            met = met[rough >= np.partition(rough, len(met) - keep)[len(met) - keep] - NEAR_TIE]
        score = cosines(np.broadcast_to(asked[i], (len(met), asked.shape[1])), rows[met])
        best = np.lexsort((ids[met], first[met], -score))[:keep]
        got.append((np.full(len(best), asked_ids[i]), ids[met][best], score[best]))
    if not got:
        return pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame(dict(zip(("q", "id", "score"), (np.concatenate(x) for x in zip(*got, strict=True)), strict=True)))


def search(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES,
           probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) over `vectors` (vec_id, embedding) for the rows where `is_query` holds; `probes`
    per table are those of the rule (`n_probes`) unless given."""
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    element = "float" if dtype == "<f4" else "double"
    good = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    rows = table(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                F.col("embedding").cast(f"array<{element}>").alias("embedding"),
                                F.coalesce(is_query, F.lit(False)).alias("asks")).where(good), "ann-rows")
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = (rows.select("embedding", "vec_id").distinct().withColumn("place", rank).where(F.col("place") <= k + 1)
               .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))      # k + 1 at most
    asking = rows.where("asks").select("embedding", "vec_id").distinct()
    asking_classes = asking.select("embedding").distinct().withColumn("asked", F.lit(True))

    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"id": [int(x[0]) for x in batch["ids"]], "ids": batch["ids"],
                                "asked": batch["asked"].notna(),
                                "dim": [len(v) for v in batch["embedding"]],
                                "vec": [(np.asarray(v, dtype=dtype) + 0.0).tobytes() for v in batch["embedding"]]})

    # the smallest id names a class; ids that repeat with other vectors are told apart by the vector's hash
    classes = table(members.join(asking_classes, "embedding", "left").select("ids", "asked", "embedding")
                    .mapInPandas(pack, "id long, ids array<long>, asked boolean, dim int, vec binary")
                    .withColumn("first_id", F.col("id")).withColumn("id", F.xxhash64("id", "vec")), "ann-classes")
    n = classes.count()
    asked = classes.where("asked")
    found = _rerank(_filed(classes, dtype, tables, n), _probing(asked, dtype, tables, n, probes), dtype, k + 1)
    best = table(_top(found, classes, k + 1), "ann-found")
    total = rows.count()
    short = (asked.join(best.groupBy("q").agg(F.sum("weight").alias("have")), F.col("id") == F.col("q"), "left")
             .where(F.coalesce("have", F.lit(0)) < min(k + 1, total)).select("id", "first_id", "dim", "vec"))
    short = table(short, "ann-short")
    if short.limit(1).count():
        one = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket")]
        again = _rerank(classes.select("dim", *one, F.lit(0).cast("long").alias("code"), "id", "first_id", "vec"),
                        short.select("dim", *one, "id", "vec", F.lit(bytes(8)).alias("codes")), dtype, k + 1)
        best = table(_top(found_union(best, again), classes, k + 1), "ann-found-all")
    answers = (best.select("q", "ids", "score").join(
        asked.select(F.col("id").alias("q"), F.col("dim"), F.col("vec")), "q")
        .join(_class_askers(asking, dtype), ["dim", "vec"])
        .select(F.col("asker").alias("query_id"), F.explode("ids").alias("vec_id"), "score")
        .where("vec_id <> query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def found_union(best: DataFrame, again: DataFrame) -> DataFrame:
    return best.select("q", "id", "score").unionByName(again)


def _top(found: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """(q, id, score, ids, weight): the `keep` best classes of each asking class, with their smallest ids."""
    told = found.distinct().join(classes.select("id", "ids", "first_id"), "id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first_id")
    return (told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
            .select("q", "id", "score", "ids", F.size("ids").alias("weight")))


def _class_askers(asking: DataFrame, dtype: str) -> DataFrame:
    """(dim, vec, asker): every query row with its vector packed like its class's."""
    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"dim": [len(v) for v in batch["embedding"]],
                                "vec": [(np.asarray(v, dtype=dtype) + 0.0).tobytes() for v in batch["embedding"]],
                                "asker": batch["vec_id"]})

    return asking.select("embedding", "vec_id").mapInPandas(pack, "dim int, vec binary, asker long")
