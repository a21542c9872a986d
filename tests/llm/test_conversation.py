"""Conversation repair against a search over all cheapest edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from windowstate.llm import conversation_repair as cr

SPACE = "\x20\t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, seq string, at long, m string, key int"


def key(x):
    return (x is not None, x if x is not None else 0)


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * {0: 0, 3: 2}.get(code, 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by Dijkstra over (rows done, role initials' automaton), audits in the key."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, place, out = heapq.heappop(heap)
        if (i, place) in seen:
            continue
        seen.add((i, place))
        if i == len(rows) and place in (0, 3):
            initials = "".join("sua"["sua".index(r[0])] for r, _ in out)
            assert GRAMMAR.fullmatch(initials)
            return cost, audit, out
        for role in ("user", "assistant"):
            if role[0] in steps[place]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, steps[place][role[0]], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, place, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] in steps[place] and role:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, steps[place][role[0]], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in steps[place]:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, steps[place][new[0]], (*out, (new, text))))
    raise AssertionError


def brute(rows, ids):
    out = {}
    for c in ids:
        mine = [(t, " " if r is None else r, " " if x is None else x) for d, t, r, x in rows if d == c]
        mine.sort(key=lambda v: (key(v[0]), v[1].encode(), hashlib.sha256(v[2].encode()).digest()))
        seen, judged = set(), []
        for _, r, x in mine:
            tail = x.rstrip(SPACE)
            fault = "blank" if not tail else "duplicate" if (r, x) in seen else "truncated" if tail[-1] not in ".!?" else ""
            seen.add((r, x))
            judged.append((r, x, fault))
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        cost, audit, repaired = cheapest(judged)
        body = "\n".join(f"{r}:{x}" for r, x in repaired)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                  *[sum(f == name for _, _, f in judged) for name in ("blank", "duplicate", "truncated")],
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest(),
                  list(repaired))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def check(spark, rows, damage=False, **kw):
    table = frame(spark, rows)
    ids = {r[0] for r in rows}
    want = brute(damaged(rows) if damage else rows, ids)
    _, stream = cr.repair(cr.damage(table) if damage else table, table, **kw)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repaired_hashes(stream).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = {c: [] for c in ids}
    for r in sorted(cr.repaired_rows(stream).collect(), key=lambda r: r["place"]):
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append((r["role"], r["text"]))
    assert lines == {c: w[-1] for c, w in want.items()}


ROLES = ["user", "assistant", "system", "tool", "User", "", None, "unit", "agent"]
TEXTS = ["Yes.", "No!", "Why? ", "cut", " ", "", None, "tail.\n", "é…", "same.", "same."]


def some(rng, conv, n):
    return [(conv, rng.choice([None, *range(n + 1)]), rng.choice(ROLES[:3] if rng.random() < .8 else ROLES),
             rng.choice(TEXTS) if rng.random() < .4 else f"text {rng.random()}{rng.choice('.!?,')}") for _ in range(n)]


@pytest.mark.parametrize("damage", [False, True])
def test_conversations(spark, damage):
    """Nulls everywhere, tied turns, repeated rows, ids that a double can't hold."""
    rng = random.Random(4)
    rows = [r for c in [*range(150), None, (1 << 60) + 1, (1 << 60) + 3] for r in some(rng, c, rng.randint(1, 12))]
    check(spark, rows + rows[:5], damage)


@pytest.mark.parametrize("rules", [0, 3, cr.RULES])
def test_long_conversations(spark, rules):
    """Over many blocks, in a table that is mostly one conversation; with and without rules."""
    rng = random.Random(rules)
    rows = some(rng, 7, 1500) + some(rng, 8, 70) + [r for c in range(20, 40) for r in some(rng, c, 6)]
    check(spark, rows, rules=rules)


def test_whole_table_is_one_row_repeated(spark):
    check(spark, [(1, 1, "user", "a.")] * 400)


def test_empty(spark):
    empty = frame(spark, [])
    _, stream = cr.repair(cr.damage(empty), empty)
    assert cr.repaired_hashes(stream).count() == 0 and cr.repaired_rows(stream).count() == 0


def test_all_rows_dropped(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    check(spark, [(3, turn, "user", "a."), (4, 5, "user", "b.")], damage=True)


def test_algebra():
    """Any bracketing of a product is the same matrix, as Re-Pair needs."""
    rng = random.Random(1)
    for _ in range(200):
        a, b, c = ("".join(rng.choices("suaxSUAX-", k=rng.randint(1, 4))) for _ in range(3))
        whole = [cr.TERMINALS[x] for x in a + b + c]
        def fold(ms):
            out = ms[0]
            for m in ms[1:]:
                out = cr.product(out, m)
            return out
        left = cr.product(cr.product(fold(whole[:len(a)]), fold(whole[len(a):len(a + b)])), fold(whole[len(a + b):]))
        right = cr.product(fold(whole[:len(a)]), cr.product(fold(whole[len(a):len(a + b)]), fold(whole[len(a + b):])))
        assert cr.packed(left) == cr.packed(right) == cr.packed(cr.unpacked(cr.packed(fold(whole))))
