"""Brute-force versions that the operators are held against, on small tables."""

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns with names the operators use inside
CLASHING = DOC_SCHEMA + ", size long, key string, id long, n long, token string, words string, ranges string, score double, `__odd` int"


def docs_frame(spark, rows, clashing=False):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    if not clashing:
        return spark.createDataFrame(full, DOC_SCHEMA)
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "t", "w", "r", 0.5, 7) for r in full], CLASHING)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingle_set(text):
    w = space_words(text)
    return set() if not w else {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_components(rows):
    """doc_id -> smallest doc_id reachable, all pairs compared."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingle_set(t))
    ids = sorted(sets)
    parent = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 75 * len(x | y):
                        u, v = find(parent, a), find(parent, b)
                        parent[max(u, v)] = min(u, v)
    return {d: find(parent, d) for d in ids}


def repeated_bytes(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept bytes) per row, in the rows' order."""
    low = {}
    raws = [((2**63 - 1 if d is None else d), (t or "").encode()) for d, t in rows]
    for d, b in raws:
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            low[s] = min(low.get(s, d), d)
    out = []
    for d, b in raws:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if low[b[i:i + length]] < d:
                gone[i:i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def window_hits(docs, items, size=10):
    """(n_words, n_hit, sorted item ids) per document."""
    windows = []
    for item, text in items:
        w = alnum_words(text)
        windows += [(str(item), w[i:i + size]) for i in range(max(1, len(w) - size + 1)) if w]
    out = []
    for _, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out.append((len(w), len(hit), sorted(found)))
    return out


def deduped_lines(rows, window=3):
    """text that is left and number of removed lines per row; rows of equal (doc_id, text) are one document."""
    order = sorted({(d is None, 0 if d is None else d, t) for d, t in rows if t is not None})
    seen, marked = set(), {}
    for key in order:
        lines = key[2].split("\n")
        marked[key] = set()
        for i in range(len(lines) - window + 1):
            w = "\n".join(lines[i:i + window])
            if not re.search(r"\S", w):
                continue
            if w in seen:
                marked[key].update(range(i, i + window))
            seen.add(w)
    out = []
    for d, t in rows:
        gone = marked[(d is None, 0 if d is None else d, t)] if t is not None else set()
        out.append((t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone)))
    return out
