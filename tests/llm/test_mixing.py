import random

import pytest

from windowstate.llm import mixing
from windowstate.llm.queries import op1_mix_sources

from .helpers import docs_frame, space_words


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess again and again; sizes: {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, "" if s is None else s.encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(w[s] for s in left), 1e-9)
        over = [s for s in left if w[s] * level >= cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, w[s] * level) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def rows_of(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "c"]
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))),
             "hot" if rng.random() < 0.4 else rng.choice(names)) for i in range(n)]


@pytest.mark.parametrize("chunk", [8192, 5])
def test_targets_and_copies(spark, chunk):
    rows = rows_of(1) + [(1000, None, "a"), (1001, "one", "tiny"), (1002, "", "empty")]
    got = {r["doc_id"]: r for r in mixing.mix(docs_frame(spark, rows, clashing=True), chunk=chunk).collect()}
    assert len(got) == len(rows)
    size = {d: len(space_words(t)) for d, t, _ in rows}
    sizes = {}
    for d, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[d]
    target = water_fill(sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for s, words in sizes.items():
        mine = [got[d] for d, _, x in rows if x == s]
        assert {r["__source_size"] for r in mine} == {words}
        assert all(abs(r["__target"] - target[s]) < 1e-6 for r in mine)
        taken = sum(r["__size"] * r["__copies"] for r in mine)
        assert abs(taken - target[s]) <= max(r["__size"] for r in mine) / 2 + 1e-6
        whole = int(target[s] / words) if words else 0
        assert all(whole <= r["__copies"] <= whole + 1 and r["__copies"] <= 3 for r in mine)
    assert all(got[d]["__size"] == size[d] for d in size)


def test_reruns_agree_and_repeats_are_one_unit(spark):
    rows = rows_of(2, 120)
    rows += rows[:10]
    twice = [sorted((r["doc_id"], r["__copies"]) for r in mixing.mix(docs_frame(spark, x)).collect())
             for x in (rows, rows[::-1])]
    assert twice[0] == twice[1]
    by_id = {}
    for d, c in twice[0]:
        by_id.setdefault(d, set()).add(c)
    assert all(len(c) == 1 for c in by_id.values())


def test_marginals_are_kept():
    import numpy as np
    size, p = np.array([9.0, 5.0, 4.0, 2.0, 1.0]), np.array([0.3, 0.6, 0.5, 0.2, 0.9])
    got = np.array([mixing._meet(size, p, np.random.default_rng(s)) for s in range(4000)])
    assert np.abs(got.mean(axis=0) - p).max() < 0.03
    assert np.abs((got * size).sum(axis=1) - (p * size).sum()).max() < 1e-9
    assert ((got > 0) & (got < 1)).sum(axis=1).max() <= 1


def test_empty(spark):
    assert mixing.mix(docs_frame(spark, [])).count() == 0
    assert [r["__copies"] for r in mixing.mix(docs_frame(spark, [(1, None), (None, "")])).collect()] == [0, 0]


def test_query(spark):
    got = op1_mix_sources(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r["taken"] <= 3 * r["size"] for r in got)
