"""Removal of repeated 50-byte strings by sorting suffixes, deep-shallow.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are judged on the
input, over whole texts as UTF-8 bytes, and never cross documents. Only the first 50 bytes of a suffix matter.

0. A text that a smaller document has whole loses everything; one document stands for each set of equal texts.
1. Every 50-byte window is filed under the smallest hash of its 20-byte grams. Neighbouring windows share it, so a
   text falls into runs of windows, about one for 15 bytes. Equal windows are filed alike.
2. Runs whose hash no other text has can't repeat and go no further. Hashes are posted in packed blocks; a hash
   that several texts of one batch have is posted once for the batch, with the number of its distinct runs there.
3. The other runs travel, with their bytes, to the task of their hash. Equal runs of a batch travel once, with their
   documents. There the suffixes are ordered: multikey quicksort on 8-byte characters to a shallow depth (suffixes
   alone in their group are done), then a blind trie for each group that still shares its prefix. Suffixes that end
   in one leaf are equal; those of a document above the leaf's smallest id are repeated.
   A hash with more than HOT_RUNS runs (a line with many surroundings) is not sorted as one group: each of its windows
   goes by the hash of its own 50 bytes, equal windows of a batch once, smallest document first, so that no more than
   a row is held.
4. The covered ranges go back to their documents, are merged, and the text keeps the rest.

Edge cases: null text counts as empty; texts of under 50 bytes lose nothing; rows equal in doc_id don't remove from
each other; a null doc_id (or the largest long) ranks after all others; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm import rolling
from windowstate.llm.common import table

LENGTH = 50
GRAM = 20
SHALLOW = 16                     # bytes that the quicksort orders; 8 a step
RUN = 64                         # windows in one run at most
PIECE = 1 << 22                  # bytes of a text that are hashed at once
CHUNK_WINDOWS = 200_000          # suffixes sorted at once, whole hashes
HASH_BYTES = 5
HOT_RUNS = 16_384                # runs of one hash that are sorted together
FLUSH = 20_000                   # windows of such hashes that a task gathers before it hands them on
LAST = (1 << 63) - 1


def _as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def window_lows(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, smallest gram hash of each window) for the windows of a text, a bounded piece at a time."""
    for lo in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
        low = rolling.grams(np.frombuffer(raw, dtype=np.uint8)[lo:lo + PIECE + LENGTH - 1], GRAM)
        span, width = 1, LENGTH - GRAM + 1
        while span < width:                            # smallest over `width` grams, by doubling
            step = min(span, width - span)
            low = np.minimum(low[step:], low[:-step])
            span += step
        yield lo, low


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, windows) of the runs of windows with one smallest gram hash."""
    out = []
    for lo, low in window_lows(raw):
        new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        size = np.diff(np.concatenate((new, [len(low)])))
        if size.max() > RUN:                           # long periods: cut into several runs
            parts = -(-size // RUN)
            first = np.repeat(np.cumsum(parts) - parts, parts)
            offset = (np.arange(parts.sum()) - first) * RUN
            new, size = np.repeat(new, parts) + offset, np.minimum(np.repeat(size, parts) - offset, RUN)
        out.append((low[new], new + lo, size))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- step 2: which hashes do several documents have

POSTED = "bucket int, owner binary, hash binary, run binary"


def _post(n_buckets: int):
    """Map side: blocks of (hash, document, run) per bucket of hashes. Columns are stored as planes of bytes, so that
    zero bytes compress: `hash` the lower 5 bytes of an entry's hash (buckets are told apart by the others, and a
    chance match only sends a run on), `owner` keys and counts of the entries' documents, `run` an entry's
    start * RUN + windows - 1. An empty `hash` marks runs that are known to be shared; entries of key 0 only say
    that a hash is, and `run` how many distinct runs of it are known."""
    def block(bucket, keys, hashes, packed):
        owner, run = _pack(keys, packed)
        return bucket, owner, _planes(hashes, HASH_BYTES) if len(hashes) else b"", run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.drop_duplicates("key")
            got = [(k, *runs(_as_bytes(t))) for k, t in zip(texts["key"], texts["text"], strict=True)]
            keys = np.repeat(np.array([g[0] for g in got], dtype=np.int64), [len(g[1]) for g in got])
            if not len(keys):
                continue
            hashes = np.concatenate([g[1] for g in got])
            packed = np.concatenate([g[2] * RUN + g[3] - 1 for g in got]).astype(np.uint64)
            order, new, group, several = _several(hashes, keys)
            known = np.zeros(len(keys), dtype=bool)
            known[order] = several[group]
            n_known = _distinct(texts["text"], got, known, order, group)[several]
            rows = []
            if known.any():
                kk, pp = keys[known], packed[known]
                part = (kk % n_buckets).astype(np.int64)
                at = np.argsort(part, kind="stable")
                for piece in np.split(at, np.flatnonzero(np.diff(part[at])) + 1):
                    rows.append(block(int(part[piece[0]]), kk[piece], np.zeros(0, np.uint64), pp[piece]))
            told = hashes[order][new][several]
            hashes = np.concatenate((hashes[~known], told))
            keys = np.concatenate((keys[~known], np.zeros(len(told), np.int64)))
            packed = np.concatenate((packed[~known], n_known.astype(np.uint64)))
            part = ((hashes >> np.uint64(8 * HASH_BYTES)) % np.uint64(n_buckets)).astype(np.int64)
            at = np.argsort(part, kind="stable")
            if len(at):
                for piece in np.split(at, np.flatnonzero(np.diff(part[at])) + 1):
                    rows.append(block(int(part[piece[0]]), keys[piece], hashes[piece], packed[piece]))
            yield pd.DataFrame(rows, columns=["bucket", "owner", "hash", "run"])
    return run


def _distinct(texts: pd.Series, got: list, known: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each group of equal hashes the number of its distinct runs, among the known ones of a batch."""
    ids = np.zeros(known.sum(), np.int64)
    at = done = 0
    for text, (_, _, start, size) in zip(texts, got, strict=True):
        mine = np.flatnonzero(known[at:at + len(start)])
        at += len(start)
        if len(mine):
            raw = _as_bytes(text)
            ends = start[mine] + size[mine] + LENGTH - 1
            ids[done:done + len(mine)] = [hash(raw[a:b]) for a, b in zip(start[mine].tolist(), ends.tolist(), strict=True)]
            done += len(mine)
    groups = np.zeros(len(known), np.int32)
    groups[order] = group
    groups = groups[known]
    by = np.lexsort((ids, groups))
    groups, ids = groups[by], ids[by]
    first = np.concatenate(([True], (groups[1:] != groups[:-1]) | (ids[1:] != ids[:-1])))[:len(by)]
    return np.bincount(groups[first], minlength=group[-1] + 1)


def _codes(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """What step 2 knows of a hash: its bucket and its lower bytes."""
    low = np.uint64(8 * HASH_BYTES)
    return (((hashes >> low) % np.uint64(n_buckets)) << low) | (hashes & np.uint64((1 << (8 * HASH_BYTES)) - 1))


def _planes(x: np.ndarray, n_bytes: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def _from_planes(raw: bytes, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(raw) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(raw, np.uint8).reshape(n_bytes, -1).T
    return out.view("<u8").ravel()


def _pack(keys: np.ndarray, packed: np.ndarray) -> tuple[bytes, bytes]:
    """(owner, run) columns of a block."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.concatenate((new, [len(keys)])))
    return _planes(keys[new], 8) + _planes(count, 8), _planes(packed, 8)


def _unpack(owner: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(owner) // 2
    keys = np.repeat(_from_planes(owner[:half], 8).view(np.int64), _from_planes(owner[half:], 8).astype(np.int64))
    return keys, _from_planes(packed, 8).astype(np.int64)


def _several(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, starts of equal hashes in it, their group numbers, which groups have several keys)."""
    order = np.lexsort((keys, hashes))
    h, k = hashes[order], keys[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(new) - 1
    several = np.zeros(group[-1] + 1, dtype=bool)
    several[group[1:][~new[1:] & (k[1:] != k[:-1])]] = True
    return order, new, group, several


def _by_document(keys: np.ndarray, packed: np.ndarray) -> pd.DataFrame:
    at = np.lexsort((packed, keys))
    at = at[np.concatenate(([True], (np.diff(keys[at]) != 0) | (np.diff(packed[at]) != 0)))[:len(at)]]
    pieces = np.split(at, np.flatnonzero(np.diff(keys[at])) + 1) if len(at) else []
    return pd.DataFrame({"content": [int(keys[p[0]]) for p in pieces], "runs": [packed[p].tobytes() for p in pieces]})


SHARED = "part int, owner binary, run binary"


def _shared(n_parts: int, hot_runs: int):
    """Reduce side, rows ordered by bucket: blocks of the runs whose hash several texts have, by part of their keys.
    Rows without owner hold the codes of hashes with more than `hot_runs` runs."""
    def decide(held, bucket) -> Iterator[pd.DataFrame]:
        keys, packed = (np.concatenate(x) for x in zip(*[_unpack(o, r) for o, _, r in held], strict=True))
        hashes = np.concatenate([_from_planes(h, HASH_BYTES) for _, h, _ in held])
        order, new, group, several = _several(hashes, keys)
        count = np.add.reduceat(np.where(keys == 0, packed, 1)[order], np.flatnonzero(new))
        hot = hashes[order][new][count > hot_runs]
        if len(hot):
            codes = hot | np.uint64(bucket << (8 * HASH_BYTES))
            yield pd.DataFrame([(bucket, b"", codes.tobytes())], columns=["part", "owner", "run"])
        good = order[several[group] & (keys[order] != 0)]
        keys, packed = keys[good], packed[good]
        at = np.lexsort((packed, keys, keys % n_parts))
        pieces = np.split(at, np.flatnonzero(np.diff(keys[at] % n_parts)) + 1) if len(at) else []
        yield pd.DataFrame([(int(keys[p[0]] % n_parts), *_pack(keys[p], packed[p])) for p in pieces],
                           columns=["part", "owner", "run"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, bytes, bytes]] = []
        bucket = None
        for batch in batches:
            known = batch[batch["hash"].map(len) == 0]           # their bucket is their part already
            yield pd.DataFrame({"part": known["bucket"], "owner": known["owner"], "run": known["run"]})
            for row in batch[batch["hash"].map(len) > 0].itertuples(index=False):
                if row.bucket != bucket and held:
                    yield from decide(held, bucket)
                    held = []
                bucket = row.bucket
                held.append((row.owner, row.hash, row.run))
        if held:
            yield from decide(held, bucket)
    return run


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ordered by part: (key, runs), one row for each text with shared runs; codes of hot hashes under no key."""
    held: list[tuple[bytes, bytes]] = []
    part = None
    for batch in batches:
        hot = batch[batch["owner"].map(len) == 0]
        yield pd.DataFrame({"content": pd.array([None] * len(hot), dtype="Int64"), "runs": hot["run"]})
        for row in batch[batch["owner"].map(len) > 0].itertuples(index=False):
            if row.part != part and held:
                yield _by_document(*(np.concatenate(x) for x in zip(*[_unpack(*h) for h in held], strict=True)))
                held = []
            part = row.part
            held.append((row.owner, row.run))
    if held:
        yield _by_document(*(np.concatenate(x) for x in zip(*[_unpack(*h) for h in held], strict=True)))


# --- step 3: order the suffixes of shared runs

SEGMENTS = "hash long, hot boolean, bytes binary, low long, places binary"
PLACE = 24                       # bytes of a place: document key, rank and start of the run


def _segments(n_buckets: int, hot: np.ndarray):
    """(hash, hot, bytes, low, places): the distinct runs of a batch with the documents and places they stand in. Of
    runs whose hash is in `hot` (codes) the single windows, each with the smallest rank that has it."""
    def frame(found: dict[tuple[int, bytes], bytes]) -> pd.DataFrame:
        return pd.DataFrame({"hash": np.array([h for h, _ in found], dtype=np.int64), "hot": False,
                             "bytes": [b for _, b in found], "low": 0, "places": list(found.values())})

    def hot_frame(windows: dict[bytes, list[bytes]]) -> pd.DataFrame:
        places = [b"".join(p) for p in windows.values()]
        low = [int(np.frombuffer(p, np.int64)[1::3].min()) for p in places]
        return pd.DataFrame({"hash": 0, "hot": True, "bytes": list(windows), "low": low, "places": places})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[int, bytes], bytes] = {}
            windows: dict[bytes, list[bytes]] = {}
            gathered = 0
            for key, order, text, held in zip(batch["key"], batch["ord"], batch["text"], batch["runs"], strict=True):
                raw = _as_bytes(text)
                packed = np.frombuffer(held, np.int64)
                start, end = packed // RUN, packed // RUN + packed % RUN + LENGTH
                lows = np.zeros(len(start), np.uint64)           # the run's hash again, from its first window
                for lo, low in window_lows(raw):
                    here = (start >= lo) & (start < lo + len(low))
                    lows[here] = low[start[here] - lo]
                is_hot = np.isin(_codes(lows, n_buckets), hot)
                for s, e in zip(start[is_hot].tolist(), end[is_hot].tolist(), strict=True):
                    at = np.arange(s, e - LENGTH + 1)
                    places = np.column_stack((np.full(len(at), key), np.full(len(at), order), at)).tobytes()
                    for i in range(len(at)):
                        windows.setdefault(raw[s + i:s + i + LENGTH], []).append(places[i * PLACE:(i + 1) * PLACE])
                    gathered += len(at)
                    if gathered >= FLUSH:
                        yield hot_frame(windows)
                        windows, gathered = {}, 0
                start, end, lows = start[~is_hot], end[~is_hot], lows[~is_hot].astype(np.int64)
                places = np.column_stack((np.full(len(start), key), np.full(len(start), order), start)).tobytes()
                for i, (h, s, e) in enumerate(zip(lows.tolist(), start.tolist(), end.tolist(), strict=True)):
                    one = h, raw[s:e]
                    place = places[i * PLACE:(i + 1) * PLACE]
                    found[one] = found[one] + place if one in found else place
            yield frame(found)
            if windows:
                yield hot_frame(windows)
    return run


def equal_groups(text: np.ndarray, at: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """Index arrays of suffixes (text[at[i]:at[i] + LENGTH]) that are equal, for groups of two or more.

    Multikey quicksort orders them by group and then one 8-byte character after the other; what is alone with its
    prefix leaves. At SHALLOW bytes the groups that are left go to a blind trie each."""
    alive = np.arange(len(at))
    for depth in range(0, SHALLOW, 8):
        word = np.zeros(len(alive), dtype=np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | text[at[alive] + depth + i].astype(np.uint64)
        order = np.lexsort((word, group))
        alive, group, word = alive[order], group[order], word[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])))[:len(alive)]
        label = np.cumsum(new) - 1
        count = np.bincount(label) if len(label) else np.zeros(0, np.int64)
        keep = count[label] > 1
        alive, group = alive[keep], label[keep]
        if not len(alive):
            return
    raw = text.tobytes()
    for members in np.split(alive, np.flatnonzero(np.diff(group)) + 1):
        yield from BlindTrie(raw, at).equal(members)


class BlindTrie:
    """A compact trie over byte strings that keeps only branching depths; a string is compared once, with the leaf
    that a blind descent finds, and enters at the depth where the two differ. Inner nodes are [depth, children],
    leaves [value, members]."""

    def __init__(self, raw: bytes, at: np.ndarray):
        self.raw, self.at = raw, at

    def equal(self, members: np.ndarray) -> Iterator[np.ndarray]:
        root, leaves = None, []
        for i, s in zip(members.tolist(), self.at[members].tolist(), strict=True):
            value = self.raw[s:s + LENGTH]
            if root is None:
                leaves.append([value, [i]])
                root = leaves[0]
                continue
            node, blind = root, False
            while type(node[1]) is dict:
                child = node[1].get(value[node[0]])
                if child is None:
                    child = next(iter(node[1].values()))
                node = child
            if node[0] == value:
                node[1].append(i)
                continue
            other = node[0]
            diff = int.from_bytes(value) ^ int.from_bytes(other)
            depth = LENGTH - (diff.bit_length() + 7) // 8
            leaf = [value, [i]]
            leaves.append(leaf)
            parent, node = None, root
            while type(node[1]) is dict and node[0] < depth:
                parent, node = node, node[1][value[node[0]]]
            if type(node[1]) is dict and node[0] == depth:
                node[1][value[depth]] = leaf
                continue
            branch = [depth, {other[depth]: node, value[depth]: leaf}]
            if parent is None:
                root = branch
            else:
                parent[1][value[parent[0]]] = branch
        for _, found in leaves:
            if len(found) > 1:
                yield np.array(found)


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce side, rows ordered by hash, hot, bytes and low: (key, start, end) of covered byte ranges."""
    held: list[tuple[int, bytes, bytes]] = []
    windows, last = 0, None
    window, least = None, 0
    for batch in batches:
        hot = batch["hot"].to_numpy(dtype=bool)
        rows, ranks = batch[hot], []
        for one, low in zip(rows["bytes"], rows["low"].tolist(), strict=True):
            if one != window:                          # its first row has the smallest document
                window, least = one, low
            ranks.append(least)
        for lo in range(0, len(rows), 1024):
            yield _later(rows["places"].iloc[lo:lo + 1024], ranks[lo:lo + 1024])
        rows = batch[~hot]
        for row in zip(rows["hash"].tolist(), rows["bytes"], rows["places"], strict=True):
            if row[0] != last and windows >= CHUNK_WINDOWS:
                yield _judge(held)
                held, windows = [], 0
            last = row[0]
            held.append(row)
            windows += len(row[1]) - LENGTH + 1
    if held:
        yield _judge(held)


def _later(places: pd.Series, least: list[int]) -> pd.DataFrame:
    """The windows at those places whose document is above the smallest one of their row."""
    place = np.frombuffer(b"".join(places), np.int64).reshape(-1, 3)
    place = place[place[:, 1] > np.repeat(np.array(least, np.int64), [len(p) // PLACE for p in places])]
    return pd.DataFrame({"key": place[:, 0], "start": place[:, 2], "end": place[:, 2] + LENGTH})


def _judge(rows: list[tuple[int, bytes, bytes]]) -> pd.DataFrame:
    """Ranges of the windows that a smaller document has, over runs of whole hashes."""
    number: dict[tuple[int, bytes], int] = {}          # distinct runs
    of_row = [number.setdefault((h, b), len(number)) for h, b, _ in rows]
    seg = np.repeat(of_row, [len(p) // PLACE for _, _, p in rows])
    place = np.frombuffer(b"".join(p for _, _, p in rows), np.int64).reshape(-1, 3)
    order = np.lexsort((place[:, 1], seg))
    seg, place = seg[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    low = place[first, 1]                              # smallest rank of each run
    size = np.array([len(b) for _, b in number])
    later = place[:, 1] > low[seg]                     # a smaller document has the whole run
    found = [(place[later, 0], place[later, 2], place[later, 2] + size[seg[later]])]
    # the smallest documents of runs that share their hash with other runs
    hashes = np.array([h for h, _ in number], dtype=np.int64)
    _, same, count = np.unique(hashes, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[same] > 1)
    if len(mixed):
        runs_bytes = list(number)
        text = np.frombuffer(b"".join(runs_bytes[i][1] for i in mixed), np.uint8)
        n = size[mixed] - LENGTH + 1
        base, begin = np.cumsum(size[mixed]) - size[mixed], np.cumsum(n) - n
        own = np.repeat(np.arange(len(mixed)), n)
        at = np.arange(n.sum()) - begin[own] + base[own]
        rank = low[mixed][own]
        hit = np.zeros(len(at), dtype=bool)
        for equal in equal_groups(text, at, same[mixed][own]):
            hit[equal[rank[equal] > rank[equal].min()]] = True
        # consecutive hit windows of a run are one range, for each of its smallest documents
        new = np.concatenate(([True], own[1:] != own[:-1]))
        lo = np.flatnonzero(hit & (new | ~np.concatenate(([False], hit[:-1]))))
        hi = np.flatnonzero(hit & (np.concatenate((new[1:], [True])) | ~np.concatenate((hit[1:], [False]))))
        run = mixed[own[lo]]
        at_first = (lo - begin[own[lo]], hi - begin[own[lo]] + LENGTH)
        smallest = np.add.reduceat((~later).astype(np.int64), first)     # places of the smallest rank come first
        times = smallest[run]
        pick = np.repeat(first[run], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found.append((place[pick, 0], place[pick, 2] + np.repeat(at_first[0], times),
                      place[pick, 2] + np.repeat(at_first[1], times)))
    key, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"key": key, "start": start, "end": end})


# --- step 4: back to the documents

def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            raw = _as_bytes(row.text)
            spans = merge_ranges([] if row.ranges is None else [(r["start"], r["end"]) for r in row.ranges])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((None if row.ord == LAST else row.ord, len(raw), sum(b - a for a, b in spans), len(spans),
                         kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def segments(whole: DataFrame, equal: DataFrame, shared: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """SEGMENTS of the shared runs; runs of a text go to the one document that stands for it."""
    by_text = (shared.where("content is not null")
               .join(equal.where("ord = least").select("content", "key").distinct(), "content").select("key", "runs"))
    out = whole.join(by_text, "key").select("key", "ord", "text", "runs").mapInPandas(_segments(n, hot), SEGMENTS)
    return out.withColumn("hash", F.when(F.col("hot"), F.xxhash64("bytes")).otherwise(F.col("hash")))


def remove_repeats(docs: DataFrame, buckets: int | None = None, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), one row per row of `docs` (doc_id, text);
    `removed` are the merged byte ranges. `buckets` (of hashes, in step 2) defaults to the shuffle partitions, which a
    cluster sets by its data."""
    spark = docs.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = docs.select(F.xxhash64(F.lit(1), "doc_id", "text").alias("key"),
                        F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text")
    equal = docs.select(F.xxhash64(F.lit(1), "doc_id", "text").alias("key"), F.xxhash64("text").alias("content"),
                        F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.unhex(F.md5("text")).alias("digest"),
                        F.octet_length("text").cast("long").alias("size")).where(F.col("size") >= LENGTH)
    equal = table(equal, "repeats-texts")
    least = equal.groupBy("content", "digest").agg(F.min("ord").alias("least"))
    equal = table(equal.join(least, ["content", "digest"]), "repeats-equal")
    copies = (equal.where("ord > least").distinct()
              .select("key", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    posted = (docs.select(F.xxhash64("text").alias("key"), "text").mapInPandas(_post(n), POSTED))
    shared = (posted.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_shared(n, hot_runs), SHARED)
              .repartition(n, "part").sortWithinPartitions("part").mapInPandas(_gathered, "content long, runs binary"))
    shared = table(shared, "repeats-shared")
    # 8 bytes for each hash of more than hot_runs runs
    hot = np.frombuffer(b"".join(r["runs"] for r in shared.where("content is null").select("runs").collect()), np.uint64)
    ranges = (segments(whole, equal, shared, n, hot).repartition(n, "hash")
              .sortWithinPartitions("hash", "hot", "bytes", "low")
              .mapInPandas(_covered, "key long, start long, end long").unionByName(copies))
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return (whole.join(ranges, "key", "left").select("ord", "text", "ranges").mapInPandas(_cut, RESULT))
