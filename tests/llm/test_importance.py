"""Importance resampling against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from windowstate.llm import importance

from .helpers import CLASHING, alnum_words, docs_frame


def grams(text):
    w = alnum_words(text)
    return [x.encode() for x in w] + [f"{a} {b}".encode() for a, b in zip(w, w[1:])]


def brute(docs, target, percent=25, buckets=10_000, seed=7):
    """(doc_id, n_features, weight, score, rank)"""
    count = lambda texts: Counter(zlib.crc32(g) % buckets for t in texts for g in grams(t))
    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for at, (d, text) in enumerate(docs):
        g = [gain[zlib.crc32(x) % buckets] for x in grams(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, at])
    fit = [r for r, (_, x) in zip(rows, docs, strict=True) if len(alnum_words(x)) >= 20]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


WORDS = ["the", "of", "Été", "x1", "naïve", "a", "1990", "straße", "中文", "q" * 255, "r" * 256, "s" * 3000]


def corpus(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS[:9] if rng.random() < .98 else WORDS) + rng.choice(["", ",", "-", "\n", " ."])
                     for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1 << 21, 64])
def test_features(monkeypatch, piece):
    """Every word and pair of words, whatever the pieces and however long the words."""
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [*corpus(80, 1), None, "", "...", "one", "A B", "\x01 \x01", "r" * 700, "r" * 300 + " " + "s" * 300 + " a " + "r" * 300,
             "p " + "t" * 5000, "t" * 5000 + " p q"]
    for (n, got), text in zip(importance.features(texts), texts, strict=True):
        assert n == len(alnum_words(text))
        assert got.tolist() == sorted(zlib.crc32(g) % 10_000 for g in grams(text))


def test_long_text():
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 800_000))
    (n, got), = importance.features([text])
    assert n == 800_000 and len(got) == 1_599_999
    assert np.array_equal(np.sort([zlib.crc32(g) % 10_000 for g in grams(text)]), got)


def test_composition():
    """CRC of head and tail from their CRCs, for every tail length of the tables."""
    for n in range(256):
        head, tail = b"head%d" % n, bytes(range(n))
        got = importance.composed(np.array([zlib.crc32(head)], np.uint32), np.array([zlib.crc32(tail)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(head + tail)


def test_resample(spark):
    docs = list(enumerate(corpus(300, 2)))
    docs += [(None, docs[1][1]), (None, None), ((1 << 60) + 1, docs[2][1]), (5, docs[5][1]), (5, docs[5][1]), (400, ""), (401, None)]
    target = [*corpus(20, 3), None, ""]
    got = importance.resample(docs_frame(spark, docs, clashing=True), docs_frame(spark, list(enumerate(target)), clashing=True))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, brute(docs, target)))


def test_one_hot_document(spark):
    """A table of one row repeated: equal scores, ranks without gaps."""
    text = " ".join(["word"] * 30)
    got = importance.resample(docs_frame(spark, [(1, text)] * 200), docs_frame(spark, [(1, "word")])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len(got) == 200


def test_empty(spark):
    empty, docs = spark.createDataFrame([], CLASHING), docs_frame(spark, [(1, "a b"), (2, " ".join(["c"] * 40))])
    assert importance.resample(empty, docs).count() == 0
    assert sorted(map(tuple, importance.resample(docs, empty).collect())) == brute([(1, "a b"), (2, " ".join(["c"] * 40))], [])
