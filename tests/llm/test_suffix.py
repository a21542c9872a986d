import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windowstate.llm import suffix_dedup as sd

from .helpers import docs_frame, repeated_bytes


def check(spark, rows, **kw):
    got = sd.remove_repeats(docs_frame(spark, rows, **kw)).collect()
    seen = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                   for r in got))
    want = sorted((d is None, d or 0, n, k, s, hashlib.sha256(b).hexdigest())
                  for (d, _), (n, k, s, b) in zip(rows, repeated_bytes(rows)))
    assert seen == want
    for r in got:
        assert r["n_removed"] == sum(x["end"] - x["start"] for x in r["removed"])


def test_against_brute_force(spark):
    rng = random.Random(4)
    common = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 60, 130, 400)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(common)[rng.randint(0, 5):])
            parts.append("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))))
        rows.append((rng.randint(0, 10**12), "".join(parts)))
    rows += [rows[3], (5, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (7, None), (8, "")]
    check(spark, rows, clashing=True)


def test_periodic_and_long(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(30000))
    check(spark, [(1, "a" * 300), (2, "a" * 120 + "b" + "a" * 49), (3, "ab" * 200), (4, "ba" * 30), (5, long),
                  (6, long[100:20000] + "x" + long[:70])])


def test_one_group_of_many_copies(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all " * 2
    check(spark, [(i, (f"{i} " if i % 3 else "") + text) for i in range(150)])


def test_common_line_in_many_surroundings_is_not_one_group(spark, monkeypatch):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = say(70)
    rows = [(rng.randint(0, 10**9), say(rng.randint(0, 60)) + line + say(rng.randint(0, 60))) for _ in range(120)]
    rows += [(i, line[20:] + str(i % 7) * 40) for i in range(60)] + [rows[0], (None, line), (3, None)]
    sorted_runs = []
    plain = sd.segments

    def seen(*args):
        sorted_runs.append(plain(*args).where("not hot").groupBy("hash").agg(F.countDistinct("bytes").alias("n"))
                           .agg(F.max("n")).first()[0] or 0)
        return plain(*args)

    monkeypatch.setattr(sd, "segments", seen)
    frame = docs_frame(spark, rows).repartition(5)
    for hot_runs in (sd.HOT_RUNS, 10, 0):
        got = sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"], r["kept_sha256"])
                     for r in sd.remove_repeats(frame, hot_runs=hot_runs).collect())
        assert got == sorted((str(d), n, k, hashlib.sha256(b).hexdigest())
                             for (d, _), (_, n, k, b) in zip(rows, repeated_bytes(rows)))
    assert sorted_runs[0] > 30 and sorted_runs[1] <= 10 and sorted_runs[2] == 0


def test_empty(spark):
    assert sd.remove_repeats(docs_frame(spark, [])).count() == 0


def test_pieces_and_small_chunks(spark, monkeypatch):
    text = "".join(random.Random(2).choice("abcdefghij ") for _ in range(900))
    old = sd.PIECE
    try:
        sd.PIECE = 64
        h, start, n = sd.runs(text.encode())
        assert n.sum() == len(text) - 49
        sd.PIECE = old
        lows = next(sd.window_lows(text.encode()))[1]
        assert (lows[start] == h).all()
    finally:
        sd.PIECE = old


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=50, max_size=70), min_size=1, max_size=12))
def test_equal_groups(texts):
    raw = [t.encode() for t in texts]
    sizes = np.array([len(b) for b in raw])
    base = np.cumsum(sizes) - sizes
    at = np.concatenate([b + np.arange(n - 49) for b, n in zip(base, sizes)])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    want = {}
    for i, a in enumerate(at):
        want.setdefault(whole[a:a + 50].tobytes(), []).append(i)
    got = sorted(sorted(g.tolist()) for g in sd.equal_groups(whole, at, np.zeros(len(at), np.int64)))
    assert got == sorted(v for v in want.values() if len(v) > 1)


def test_merge_ranges():
    assert sd.merge_ranges([(5, 9), (0, 3), (3, 4), (8, 20)]) == [(0, 4), (5, 20)]
