"""Target-distribution importance resampling over hashed word features.

Features of a text are its words and its pairs of consecutive words. A feature's bucket is the CRC-32 of its bytes
modulo `BUCKETS`; bucket frequencies in the corpus and in the target texts give each bucket a gain, a document's
weight is its mean gain, and seeded Gumbel noise turns weights into a draw without replacement.

Buckets come from an Aho-Corasick dictionary: the distinct words of a piece of text, each between delimiters, with the
CRC and length of the word as payload. One pass of the automaton over the piece gives the payloads of its words in
order, and neighbours are composed: CRC-32 is linear, so the CRC of "a b" is that of "a" shifted by the length of " b"
(a table look-up) xor that of " b". No pair of words is ever built as a string. A dictionary covers at most `PIECE`
bytes of text (several texts, or a part of a long one that starts with the last word of the part before it), so memory
is bounded by the piece and no word is left out; words of more than `LONG_WORD` bytes stand as a marker in the piece
and bring their payload themselves.

Every text is scanned once; its sorted bucket numbers are stored, and both counting and weighing read those.
Ranks come from a sort by ranges over all tasks.

Edge cases: null texts and texts without words have no features, weight 0 and no rank; a null doc_id takes its noise
from the empty id and comes last among ties; rows of one doc_id share their noise and each may be drawn; empty tables
(corpus or target) work; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm import rolling
from windowstate.llm.common import numbered, table

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 7
PERCENT = 25
PIECE = 1 << 21
LONG_WORD = 255
_LONG = re.compile(rb"[^ \n]{%d,}" % (LONG_WORD + 1))
_POLYNOMIAL = 0xEDB88320            # CRC-32, reflected


def _shift_tables() -> np.ndarray:
    """[n, k, b]: the CRC register with byte b at place k after n zero bytes, for n up to LONG_WORD + 1."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    out = np.empty((LONG_WORD + 2, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


_SHIFT = _shift_tables()


def composed(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of heads followed by tails, from the heads' and tails' CRCs and the tails' lengths."""
    out = tail.copy()
    for k in range(4):
        out ^= _SHIFT[length, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _pieces(folded: bytes) -> Iterator[tuple[bytes, bool]]:
    """(part, first): parts of about PIECE bytes cut between words; a later part starts with the last word of the
    part before it."""
    lo, first = 0, True
    while True:
        hi = len(folded)
        if hi - lo > PIECE:
            one = folded.find(b" ", lo)                     # two words at least, whatever their lengths
            two = folded.find(b" ", one + 1) if one >= 0 else -1
            hi = max(two, folded.rfind(b" ", lo, lo + PIECE)) if two >= 0 else hi
        yield folded[lo:hi], first
        if hi >= len(folded):
            return
        lo, first = folded.rfind(b" ", lo, hi) + 1, False


def _scan(parts: list[bytes]) -> list[np.ndarray]:
    """For each part (single-spaced words) the CRCs of its words, then those of its word pairs, as (words, pairs)."""
    joined = b"\n".join(b" " + p + b" " for p in parts)
    long_words: list[bytes] = []

    def marked(m: re.Match) -> bytes:
        long_words.append(m.group())
        return b"\x01"

    joined = _LONG.sub(marked, joined)
    words = list(set(joined.split()) - {b"\x01"})
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(words):
        automaton.add_word(f" {w.decode('latin-1')} ", i)
    n = len(words)
    automaton.add_word("\n", n)
    automaton.add_word(" \x01 ", n + 1)
    automaton.make_automaton()
    ids = np.fromiter((i for _, i in automaton.iter(joined.decode("latin-1"))), dtype=np.int64)
    is_long = np.flatnonzero(ids == n + 1)
    ids[is_long] = n + 1 + np.arange(len(is_long))
    payload = [*words, b"", *long_words]
    crc = np.fromiter((zlib.crc32(w) for w in payload), dtype=np.uint32, count=len(payload))
    tail = np.fromiter((zlib.crc32(b" " + w) for w in payload), dtype=np.uint32, count=len(payload))
    length = np.fromiter((len(w) + 1 for w in payload), dtype=np.int64, count=len(payload))
    single = crc[ids]
    after = ids[1:]
    pair = composed(single[:-1], tail[after], np.minimum(length[after], LONG_WORD + 1))
    for at in is_long[is_long > 0].tolist():               # a long second word: its bytes go on from the first's CRC
        pair[at - 1] = zlib.crc32(b" " + payload[ids[at]], int(single[at - 1]))
    ends = np.append(np.flatnonzero(ids == n), len(ids)).tolist()
    out, lo = [], 0
    for hi in ends:
        out.append((single[lo:hi], pair[lo:max(lo, hi - 1)]))
        lo = hi + 1
    return out


def features(texts: list[str | None], buckets: int = BUCKETS) -> list[tuple[int, np.ndarray]]:
    """(number of words, sorted bucket numbers with repeats) of each text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    n_words = [0] * len(texts)
    held: list[tuple[int, bytes, bool]] = []
    size = 0

    def flush() -> None:
        for (i, _, first), (single, pair) in zip(held, _scan([p for _, p, _ in held]), strict=True):
            single = single if first else single[1:]
            n_words[i] += len(single)
            found[i] += [(single % buckets).astype(np.uint16), (pair % buckets).astype(np.uint16)]
        held.clear()

    for i, text in enumerate(texts):
        folded = b" ".join(rolling.alnum_words(text))
        if not folded:
            continue
        for part, first in _pieces(folded):
            if held and size + len(part) > PIECE:
                flush()
                size = 0
            held.append((i, part, first))
            size += len(part)
    if held:
        flush()
    none = np.zeros(0, dtype=np.uint16)
    return [(n, np.sort(np.concatenate(f)) if f else none) for n, f in zip(n_words, found, strict=True)]


def featurised(docs: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """`keep` columns plus (n_words, n_features, buckets): the sorted bucket numbers, two bytes each."""
    if buckets > 1 << 16:
        raise ValueError("bucket numbers are kept in two bytes")

    @F.pandas_udf("n_words long, n_features long, buckets binary")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = features(texts.tolist(), buckets)
            yield pd.DataFrame({"n_words": [n for n, _ in got], "n_features": [len(b) for _, b in got],
                                "buckets": [b.tobytes() for _, b in got]})

    return docs.select(*keep, scan("text").alias("__f")).select(*keep, "__f.*")


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket over all rows: a partial count per task, at most `buckets` rows at the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in batch["buckets"]:
                total += np.bincount(np.frombuffer(b, dtype=np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = (feats.select("buckets").where("n_features > 0").mapInPandas(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln) of each bucket's smoothed frequency ratio, target to corpus."""
    k, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k))))
            for s, t in zip(corpus, target, strict=True)]


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of `docs` (doc_id, text) towards `target` (text)."""
    feats = table(featurised(docs, ["doc_id"], buckets), "importance-features")
    gain = np.array(gains(bucket_counts(feats, buckets), bucket_counts(featurised(target, [], buckets), buckets)),
                    dtype=np.int64)

    @F.pandas_udf("long")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            arrays = [np.frombuffer(b, dtype=np.uint16) for b in batch]
            yield pd.Series([int(gain[a].sum()) // len(a) if len(a) else 0 for a in arrays], dtype="int64")

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return (feats.select("doc_id", "n_words", "n_features", weight("buckets").alias("weight"))
            .withColumn("score", F.col("weight") + noise))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`: the `percent` highest scores among the rows of
    `min_words` words or more are drawn and ranked from 1, ties to the smaller doc_id; the others' rank is null."""
    rows = scored(docs, target, buckets, seed).withColumn("__row", F.monotonically_increasing_id())
    rows = table(rows, "importance-scores")
    fit = F.col("n_words") >= min_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    ranked = numbered(rows.where(fit), order, "importance-order")
    n = rows.where(fit).count()
    rank = F.when(F.col("__at") < percent * n // 100, F.col("__at") + 1).alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank).unionByName(rows.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))
