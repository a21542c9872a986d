import random

import pytest

from windowstate.llm import near_dup
from windowstate.llm.components import components

from .helpers import docs_frame, find, near_components, shingle_set


def say(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edit(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def check(spark, rows, **kw):
    got = near_dup.near_duplicates(docs_frame(spark, rows, **kw)).collect()
    assert len(got) == len(rows)
    want = near_components([r for r in rows if r[0] is not None])
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, set()).add(len(shingle_set(t)))
    for r in got:
        assert r["n_shingles"] in by_id[r["doc_id"]]
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    return got


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows, bases = [], [say(rng, n) for n in (5, 8, 30, 120, 400)]
    for _ in range(120):
        b = rng.choice(bases)
        rows.append((rng.randrange(10**12), edit(rng, b, rng.choice([0, 0, 1, 2, len(b) // 200, len(b) // 60]))))
    rows += [(i, say(rng, rng.randint(0, 60))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, "only four words here"), (54, "Only FOUR words\there"),
             (55, "one"), (None, bases[3]), (None, None), rows[0], (rows[1][0], rows[2][1])]
    check(spark, rows, clashing=True)


@pytest.mark.parametrize("block", [512, 8])
def test_chains_and_grey_zone(spark, monkeypatch, block):
    """Each link of a chain is near its neighbour only, and copies of one hidden base lie about the threshold."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(2)
    rows, text = [], say(rng, 200, 10**6)
    for i in range(25):
        rows.append((1000 - i, text))
        text = edit(rng, text, 4)
    base = say(rng, 300, 10**6)
    rows += [(2000 + i, edit(rng, base, rng.randint(3, 9))) for i in range(40)]
    check(spark, rows)


def test_empty(spark):
    assert near_dup.near_duplicates(docs_frame(spark, [])).count() == 0
    assert near_dup.near_duplicates(docs_frame(spark, [(1, None)])).first()["component_id"] == 1


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)]
    links += [(500, i) for i in range(501, 700)] + [(7, 7)]
    parent = {x: x for e in links for x in e}
    for a, b in links:
        u, v = find(parent, a), find(parent, b)
        parent[max(u, v)] = min(u, v)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_ids_beside_null_ids(spark):
    """Ids that a double can't hold, in one batch with nulls: unlike documents stay apart, copies meet."""
    import corpus_pipeline
    big = 1 << 60
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(big + 1, texts[0]), (None, texts[1]), (big + 3, texts[2]), (5, texts[3]), (big + 5, texts[2])]
    docs = docs_frame(spark, rows).coalesce(1)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect() if r["doc_id"])
    assert got == [(5, 5, True), (big + 1, big + 1, True), (big + 3, big + 3, True), (big + 5, big + 3, False)]
    kept = corpus_pipeline.dedup_near(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, [big + 1, None, big + 3, 5]))
    assert {r["text"] for r in kept} == set(texts)
