"""Exact dedup against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from windowstate.llm import exact_dedup
from windowstate.llm.queries import LLM_QUERIES

from .helpers import CLASHING, docs_frame


def brute(rows):
    bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), body in zip(rows, bodies, strict=True):
        ids = [i for (i, _), b in zip(rows, bodies, strict=True) if b == body]
        known = [i for i in ids if i is not None]
        out.append((d, min(known) if known else None, len(ids), hashlib.sha256(body.encode()).hexdigest()))
    return out


BIG = 1 << 60
ROWS = [(5, "a  b"), (3, "a\tb"), (BIG + 1, "a \n b"), (9, "a b "), (1, "A b"), (None, "a b"), (7, None), (8, ""), (12, " "),
        (BIG + 3, "x" * 100_000), (BIG + 5, "x" * 100_000), (None, "nobody"), (None, "nobody"), (20, "é ü"), (21, "é ü"),
        (30, "same"), (30, "same"), (31, "same")] + [(100 + i, "hot") for i in range(500)]


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda body: F.substring(F.md5(body), 1, 1)])
def test_groups(spark, digest):
    """A hash of one hex digit makes many collisions, which the bytes take apart."""
    got = exact_dedup.exact_groups(docs_frame(spark, ROWS, clashing=True), digest).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == sorted(map(str, brute(ROWS)))
    kept = {}
    for r in got:
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
    assert kept == dict.fromkeys({r["text_sha256"] for r in got}, 1)


def test_drop_copies(spark):
    docs = docs_frame(spark, ROWS, clashing=True)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    want = {(keep, sha) for _, keep, _, sha in brute(ROWS)}
    rows = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest())
            for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_empty_and_native(spark):
    empty = spark.createDataFrame([], CLASHING)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    plan = LLM_QUERIES["op13_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
