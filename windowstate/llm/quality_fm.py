"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(b + w.x + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2))

so pairwise interactions of rank `RANK` cost linear time in the features of a document. Features are word counts
hashed to `WORD_BINS` (log-scaled, unit length), and structure statistics plus n_chars in quantile bins.
Never inputs: labels, lang, source, doc_id. The model is fitted with Adam on at most `SAMPLE_ROWS` labelled
documents (the documented bound, drawn by id hash); scoring reads every whole text, Arrow batch by batch.

Edge cases: null or empty text has no words and is scored from its statistics; a null n_chars has a bin of its own;
without any labelled row every score is 0.5, with one class only the scores lean to it; documents labelled several
times take the majority (ties: 1); other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowstate.llm import rolling

SAMPLE_ROWS = 6000
WORD_BINS = 4096
STAT_BINS = 8
RANK = 8
EPOCHS = 25
BATCH = 128
RATE = 0.01
DECAY = 1e-4
SEED = 7
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", dtype=np.uint8))
PLAIN = np.isin(np.arange(256), np.frombuffer(b".,;:'\"-?", dtype=np.uint8))
N_STATS = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, values, statistics) of one whole text; statistics hold nan where they don't apply."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    b = np.frombuffer(raw, dtype=np.uint8)
    stats = np.full(N_STATS, np.nan)
    stats[0] = np.log1p(n)
    if n_chars is not None and n_chars == n_chars:
        stats[1] = np.log1p(max(float(n_chars), 0.0))
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0), stats
    h = rolling.word_hashes(b" ".join(words).lower())
    counts = np.bincount((h % np.uint64(WORD_BINS)).astype(np.int64), minlength=WORD_BINS)
    bins = np.flatnonzero(counts)
    values = np.log1p(counts[bins])
    values /= np.sqrt((values * values).sum())
    size = len(b)
    sorted_h = np.sort(h)
    new = np.flatnonzero(np.concatenate(([True], sorted_h[1:] != sorted_h[:-1])))
    lines = raw.split(b"\n")
    ends = np.frombuffer(b"".join(w[-1:] for w in words), dtype=np.uint8)
    stats[2] = (size - n + 1) / n
    stats[3] = ((b >= 65) & (b <= 90)).sum() / size
    stats[4] = ((b >= 48) & (b <= 57)).sum() / size
    stats[5] = PUNCTUATION[b].sum() / size
    stats[6] = (PUNCTUATION[b] & ~PLAIN[b]).sum() / size
    stats[7] = (b >= 128).sum() / size
    stats[8] = np.log1p(n / len(lines))
    stats[9] = len(new) / n
    stats[10] = np.diff(np.concatenate((new, [n]))).max() / n
    stats[11] = (h[1:] == h[:-1]).mean() if n > 1 else 0.0
    stats[12] = PUNCTUATION[ends].mean()
    stats[13] = (PUNCTUATION[ends] & ~PLAIN[ends]).mean()
    stats[14] = 1 - len(set(lines)) / len(lines)
    stats[15] = max(map(len, words)) / size
    return bins, values, stats


@dataclass
class Model:
    edges: np.ndarray          # N_STATS x (STAT_BINS - 1) quantiles
    bias: float
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def width() -> int:
        return WORD_BINS + N_STATS * (STAT_BINS + 1)

    def stat_bins(self, stats: np.ndarray) -> np.ndarray:
        """Positions of the statistics' one-hot features; the last bin of each is for nan."""
        bins = np.array([np.searchsorted(e, x, side="right") if x == x else STAT_BINS
                         for e, x in zip(self.edges, stats, strict=True)])
        return WORD_BINS + np.arange(N_STATS) * (STAT_BINS + 1) + bins

    def score(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of a batch of documents, in time linear in their features."""
        if not docs:
            return np.zeros(0)
        at = [np.concatenate((bins, self.stat_bins(stats))) for bins, _, stats in docs]
        x = np.concatenate([np.concatenate((values, np.full(N_STATS, STAT_VALUE))) for _, values, _ in docs])
        starts = np.concatenate(([0], np.cumsum([len(a) for a in at])[:-1]))
        at = np.concatenate(at)
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        z = self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


STAT_VALUE = 0.25      # each one-hot statistic; sixteen of them have unit length like the words


def fit(sample: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Logistic loss by Adam over shuffled batches; batches are dense, of bounded width."""
    rng = np.random.default_rng(SEED)
    d = Model.width()
    if not len(y):
        return Model(np.zeros((N_STATS, STAT_BINS - 1)), 0.0, np.zeros(d), np.zeros((d, RANK)))
    stats = np.array([s for _, _, s in sample])
    at = np.linspace(0, 1, STAT_BINS + 1)[1:-1]
    edges = np.array([np.quantile(c[c == c], at) if (c == c).any() else np.zeros(len(at)) for c in stats.T])
    share = min(max(float(np.mean(y)), 0.01), 0.99)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(d), rng.normal(0, 0.05, (d, RANK)))
    bins = [np.concatenate((b, model.stat_bins(s))) for b, _, s in sample]
    values = [np.concatenate((v, np.full(N_STATS, STAT_VALUE))) for _, v, _ in sample]
    params = {"b": np.array([model.bias]), "w": model.w, "v": model.v}
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            rows = order[start:start + BATCH]
            x = np.zeros((len(rows), d))
            for r, i in enumerate(rows):
                x[r, bins[i]] = values[i]
            sums = x @ params["v"]
            x2 = x * x
            z = params["b"][0] + x @ params["w"] + 0.5 * (sums * sums - x2 @ (params["v"] ** 2)).sum(axis=1)
            err = (1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))) - y[rows]) / len(rows)
            grads = {"b": np.array([err.sum()]), "w": x.T @ err + DECAY * params["w"],
                     "v": x.T @ (err[:, None] * sums) - (x2.T @ err)[:, None] * params["v"] + DECAY * params["v"]}
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (RATE * (first[k] / (1 - 0.9 ** step))
                              / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8))
    model.bias = float(params["b"][0])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, n_chars, y) of at most `rows` labelled documents that are not held out. The chosen ids are at
    most `rows`, so they are broadcast and the texts stay where they are. Equal rows count once; an id
    with several texts gives its share of `rows` of them, by a seeded hash."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows))
    ids = chosen.select(F.col("doc_id").alias("__id"), "y")
    share = rows // max(1, chosen.count())
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("__fp", F.lit(SEED)), "__fp"))
    return (docs.select("doc_id", "text", "n_chars").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
            .withColumn("__fp", F.xxhash64("text", "n_chars")).dropDuplicates(["doc_id", "__fp"])
            .withColumn("__place", place).where(F.col("__place") <= share).select("doc_id", "text", "n_chars", "y"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Features are made on the executors; the driver gets at most the bounded sample's features."""
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(t, n) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"],
                                "bins": [b.astype(np.int16).tobytes() for b, _, _ in got],
                                "vals": [v.astype(np.float32).tobytes() for _, v, _ in got],
                                "stats": [s.tobytes() for _, _, s in got]})

    got = (labelled_sample(docs, labels, rows)
           .mapInPandas(extract, "doc_id long, y int, bins binary, vals binary, stats binary").collect())
    got.sort(key=lambda r: (r["doc_id"], bytes(r["bins"]), bytes(r["vals"])))
    sample = [(np.frombuffer(r["bins"], np.int16).astype(np.int64), np.frombuffer(r["vals"], np.float32).astype(float),
               np.frombuffer(r["stats"], float)) for r in got]
    return fit(sample, np.array([r["y"] for r in got], dtype=float))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` plus __score (double). Only text and n_chars are read for the score."""
    def score(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, n_chars in texts:
            out = np.zeros(len(text))
            for lo in range(0, len(text), 256):
                hi = min(lo + 256, len(text))
                out[lo:hi] = model.score([features(t, n) for t, n in zip(text[lo:hi], n_chars[lo:hi], strict=True)])
            yield pd.Series(out)

    udf = F.pandas_udf(score, "double")
    return docs.withColumn("__score", udf(F.col("text"), F.col("n_chars").cast("double")))
