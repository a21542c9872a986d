"""MinHash near-duplicates through an inverted join on signature coordinates.

1. Every text gives its set of 5-word shingles, the set's size and digest, and a signature of `COORDINATES` minimum
   hashes. Texts with equal sets are one class; its smallest doc_id stands for it.
2. A class is posted under its (coordinate, value) tokens. Pairs must agree in at least `MIN_MATCHES` coordinates, so
   tokens that no other class has can not help, and with tokens ordered by rarity two such classes share one of their
   `COORDINATES - MIN_MATCHES + 1` rarest (prefix filter). Only those are posted.
3. Each posting list counts collisions between its classes, skipping by size those that can't reach the similarity
   and those that the list has connected already, and gives a spanning forest of its candidate pairs. The forests'
   components are candidate groups: every pair that agrees enough lies within one.
4. In a candidate group the pairs that agree enough are confirmed on full shingle sets (64-bit hashes), skipping what
   is connected already. Only confirmed links leave, again as a forest; their components are the result.

Long lists and groups are dealt out as pairs of blocks, so no task holds more than two blocks, and output grows with
the classes, not with their pairs. A pair of similarity 0.75 agrees in 96 of 128 coordinates on average (standard
deviation 4.9); fewer than 70 has a probability of about 1e-7.

Edge cases: a text of fewer than five words has one shingle, its whole word sequence; null or wordless texts have no
shingles and link with nothing; a null doc_id has no component and is kept; rows of one doc_id are one document
whose texts' links all count; an empty table works.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm import rolling
from windowstate.llm.common import table
from windowstate.llm.components import components

SHINGLE = 5
COORDINATES = 128
MIN_MATCHES = 70
PREFIX = COORDINATES - MIN_MATCHES + 1
NUM, DEN = 75, 100          # similarity of at least NUM / DEN
BLOCK = 512                 # classes of a list or group in one block
SEED = 11


@cache
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(rolling.shingle_hashes(rolling.space_words(text), SHINGLE))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest of (a * h + b) mod 2^32 per coordinate, in slices that stay in cache."""
    a, b = _coefficients()
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(h), 1024):
        part = a[:, None] * h[None, lo:lo + 1024]
        part += b[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def brief(sig: np.ndarray) -> np.ndarray:
    """One byte a coordinate: comparing them can only add matches, a quarter of a match a pair on average."""
    return rolling.mix(sig.astype(np.uint64)).astype(np.uint8)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, sig, brief): set size, digest of the sorted set, signature (null without shingles). Only
    texts go through pandas, where a column of ids with a null would become doubles."""
    @F.pandas_udf("n long, digest binary, sig binary, brief binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch]
            sigs = [signature(x) if len(x) else None for x in sets]
            yield pd.DataFrame({
                "n": [len(x) for x in sets],
                "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                "sig": [None if x is None else x.tobytes() for x in sigs],
                "brief": [None if x is None else brief(x).tobytes() for x in sigs]})

    return docs.select("doc_id", sketch("text").alias("s")).select(F.col("doc_id").cast("long").alias("doc_id"), "s.*")


def _tokens(classes: DataFrame) -> DataFrame:
    """(id, token): coordinate and value of each signature entry packed in one long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo:lo + 2048]
                sig = np.frombuffer(b"".join(part["sig"]), dtype=np.uint32).reshape(len(part), COORDINATES)
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), COORDINATES),
                                    "token": (high[None, :] | sig.astype(np.int64)).ravel()})

    return classes.select("id", "sig").mapInPandas(run, "id long, token long")


def postings(classes: DataFrame) -> DataFrame:
    """(id, token) of the prefix tokens that another class shares, rarest first by their counts over all classes."""
    tokens = _tokens(classes)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rare = (tokens.join(shared, "token").groupBy("id")
            .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t")))   # at most COORDINATES entries
    # unshared tokens are the rarest and fill the prefix first
    left = F.size("t") - (MIN_MATCHES - 1)
    return (rare.where(left > 0)
            .select("id", F.explode(F.slice("t", F.lit(1), F.least(left, F.lit(PREFIX)))).alias("e"))
            .select("id", F.col("e.token").alias("token")))


def _dealt(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows of each key as pairs of blocks, ordered for `_runs`: sizes (key, len). A row of block i goes to the pair
    of i and every block, named (x, y) with x <= y."""
    rows = (rows.join(sizes, key).withColumn("blocks", F.ceil(F.col("len") / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = (rows.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
            .drop("other", "blocks", "len"))
    return rows.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y", "n", "id")


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of rows with one (key, x, y); runs go over the ends of batches."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        cols = {c: batch[c].to_numpy() for c in batch.columns}
        if held:
            cols = {c: np.concatenate((held[c], v)) for c, v in cols.items()}
        where = [cols[c] for c in (key, "x", "y")]
        new = np.flatnonzero(np.logical_or.reduce([w[1:] != w[:-1] for w in where])) + 1
        ends = np.concatenate((new, [len(where[0])]))
        lo = 0
        for hi in ends[:-1].tolist():
            yield {c: v[lo:hi] for c, v in cols.items()}
            lo = hi
        held = {c: v[lo:] for c, v in cols.items()}
    if held and len(held[key]):
        yield held


def _partners(run: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, later rows that agree enough with row i and are not connected to it, labels). The caller connects rows by
    changing the labels. Rows are ordered by set size, so partners that are too large form the end."""
    n, block = run["n"], run["block"]
    across = run["x"][0] != run["y"][0]
    short = np.ascontiguousarray(np.frombuffer(b"".join(run["brief"]), np.uint8).reshape(len(n), COORDINATES).T)
    _, labels = np.unique(run["id"], return_inverse=True)
    reach = np.searchsorted(n, n * DEN // NUM, side="right")
    for i in range(len(n) - 1):
        wanted = labels[i + 1:reach[i]] != labels[i]
        if across:
            wanted &= block[i + 1:reach[i]] != block[i]
        at = np.flatnonzero(wanted) + i + 1
        if len(at):
            agree = np.add.reduce(short[:, at] == short[:, i:i + 1], axis=0, dtype=np.uint8)
            at = at[agree >= MIN_MATCHES]
            if len(at):
                yield i, at, labels


def _connect(i: int, found: np.ndarray, labels: np.ndarray) -> list[int]:
    """Joins the components of `found` to that of row i; the one of each that does it."""
    used = []
    for j in found[np.unique(labels[found], return_index=True)[1]].tolist():
        if labels[j] != labels[i]:
            used.append(j)
            labels[labels == labels[j]] = labels[i]
    return used


def _pairs(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})


def candidate_links(posted: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the pairs of each posting list that agree enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in _runs(batches, "token"):
            if len(r["id"]) > 1:
                yield _pairs(r["id"], [(i, j) for i, at, labels in _partners(r) for j in _connect(i, at, labels)])

    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    rows = posted.join(classes.select("id", "n", "brief"), "id")
    return _dealt(rows, "token", lists).mapInPandas(run, "a long, b long").distinct()


def confirmed_links(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): for every candidate group (id, component) a forest of the pairs whose full sets reach the
    similarity. Texts of grouped classes only go on, as their shingle sets."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo:lo + 512]
                got = [shingles(t) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "component": part["component"], "n": [len(x) for x in got],
                                    "brief": [brief(signature(x)).tobytes() for x in got],
                                    "shingles": [x.tobytes() for x in got]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in _runs(batches, "component"):
            if len(r["id"]) > 1:
                yield _pairs(r["id"], _confirm(r))

    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = (texts.join(groups, F.col("doc_id") == F.col("id")).select("id", "component", "text")
            .mapInPandas(sets, "id long, component long, n long, brief binary, shingles binary").where("n > 0"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("len"))
    return _dealt(rows, "component", sizes).mapInPandas(run, "a long, b long").distinct()


def _confirm(run: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Exact similarities of the pairs that agree enough: the members of row i's set are flagged, and a sum over a
    partner's members counts what both have."""
    n = run["n"]
    _, member = np.unique(np.frombuffer(b"".join(run["shingles"]), np.uint64), return_inverse=True)
    starts = np.cumsum(n) - n
    flags = np.zeros(member.max() + 1, dtype=np.int64)
    links = []
    for i, at, labels in _partners(run):
        own = member[starts[i]:starts[i] + n[i]]
        flags[own] = 1
        if len(at) < 32:
            common = np.array([flags[member[starts[j]:starts[j] + n[j]]].sum() for j in at])
        else:
            common = np.add.reduceat(flags[member], starts)[at]
        flags[own] = 0
        good = at[DEN * common >= NUM * (n[i] + n[at] - common)]
        links += [(i, j) for j in _connect(i, good, labels)]
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs` (which holds doc_id and text)."""
    sketch = table(sketches(docs), "neardup-sketches")
    have = sketch.where("n > 0 and doc_id is not null")
    same = have.groupBy("digest").agg(F.min("doc_id").alias("id"))
    members = table(have.select("doc_id", "digest").join(same, "digest").select("doc_id", "id").distinct(),
                    "neardup-members")
    classes = table(have.join(same.select("id", F.col("digest").alias("d")),
                              (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("id")))
                    .select("id", "n", "sig", "brief").dropDuplicates(["id", "n", "sig"]), "neardup-classes")
    posted = table(postings(classes), "neardup-postings")
    groups = components(candidate_links(posted, classes), "neardup-groups")
    links = confirmed_links(groups, docs.select("doc_id", "text"))
    copies = members.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    full = components(links.unionByName(copies), "neardup-components")
    final = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(
        full.select(F.col("id").alias("i"), "component"), F.col("doc_id") == F.col("i"), "left")
    component = F.coalesce("component", "doc_id")
    return final.select("doc_id", "n_shingles", component.alias("component_id"),
                        component.eqNullSafe(F.col("doc_id")).alias("kept"))
