import random

import pytest

from windowstate.llm import license_scan as ls
from windowstate.llm.queries import op6_license_scan

from .helpers import alnum_words, docs_frame


def brute(text):
    w = alnum_words(text)
    places = [(i, label) for phrase, label in ls.BASE_PHRASES.items() for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def test_base_places(spark):
    rng = random.Random(1)
    bits = ["under the MIT license", "Apache License, Version 2", "CC-BY-NC", "under the", "license", "cc by", "nc",
            "é", "\n", "..", "mit", "cc by nc cc by nc"]
    rows = [(i, rng.choice(["", " "]).join(f"{rng.choice(bits)}{rng.choice([' ', '', '-'])}" for _ in range(rng.randint(0, 9))))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "under the mit license " * 20000), (None, "cc by nc")]
    out = ls.scan_licenses(docs_frame(spark, rows, clashing=True))
    for r in out.collect():
        got = r["__license"]
        text = r["text"]
        assert tuple(got)[:5] == brute(text)
        assert set(got["base_labels"].split(",")) <= set(got["labels"].split(",")) | {""}
        assert 0 <= got["score"] <= 1
    assert ls.scan_licenses(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("line, ids, value", [
    ("MIT", {"mit"}, 1.0),
    ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 1.0),
    ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.4),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only"}, 0.7),
    ("MIT AND (CC-BY-NC-4.0 OR ISC)", {"mit", "cc-by-nc-4.0", "isc"}, 1.0),
    ("MIT AND CC-BY-NC-4.0 OR ISC", {"mit", "cc-by-nc-4.0", "isc"}, 1.0),
    ("CC-BY-NC-4.0 OR ISC AND AGPL-3.0-only", {"cc-by-nc-4.0", "isc", "agpl-3.0-only"}, 0.3),
    ("MIT and this is the rest of the line", {"mit"}, 1.0),
    ("MIT. And more", {"mit"}, 1.0),
    ("this is prose", set(), 0.0),
    ("LicenseRef-Acme OR foo-1.2", {"licenseref-acme", "foo-1.2"}, 0.5),
    ("GPL-2.0+ AND CC-BY-NC-SA-3.0", {"gpl-2.0+", "cc-by-nc-sa-3.0"}, 0.2),
    ("((MIT", {"mit"}, 1.0),
    ("OR MIT", {"mit"}, 1.0),
    (")(", set(), 0.0),
    ("", set(), 0.0),
])
def test_expressions(line, ids, value):
    got = ls.evaluate(ls.expression_tokens(line))
    assert got[0] == ids and abs(got[1] - value) < 1e-12


def test_precedence():
    assert ls.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert ls.postfix("( a or b ) and c".split()) == ["a", "b", "or", "c", "and"]
    assert ls.postfix("a or or b".split()) is None and ls.postfix("( a".split()) is None and ls.postfix([]) is None


def test_tags():
    a = ls.automaton()
    got = ls.scan("# SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode under the mit license", a)
    assert got[5] == "apache-2.0,mit" and got[4] == "mit" and got[6] == 1.0
    assert ls.scan("All rights reserved. GNU General Public License", a)[5:] == ("gpl,proprietary", 0.0)
    assert ls.scan("nothing here", a) == (2, 0, None, None, "", "", 0.0)


def told(text):
    """labels and score by plain search and recursive descent, apart from the operator's automaton and stacks."""
    words = " " + " ".join(alnum_words(text)) + " "
    labels, values = set(), []
    for phrase, label in ls.BASE_PHRASES.items():
        if f" {phrase} " in words:
            labels.add(label)
            values.append(ls.openness(label))
    for at in range(len(words)):
        here = [p for p in ls.NOTICES if words.startswith(f" {p} ", at)]
        if here:
            label = ls.NOTICES[max(here, key=len)]
            labels.add(label)
            values.append(ls.openness(label))
    for line in (text or "").split("\n"):
        low = line.lower()
        while "spdx-license-identifier:" in low:
            low = low.split("spdx-license-identifier:", 1)[1].lstrip(" )\t")
            tokens = ls.expression_tokens(low)
            names = {t for t in tokens if t not in ("and", "or", "with", "(", ")")}
            try:
                rest = list(tokens)
                names, value = descend(rest, 1)
                if rest:
                    raise IndexError
            except IndexError:
                names = {t for t in tokens if t not in ("and", "or", "with", "(", ")")}
                value = min((0.5 if ls.openness(t) is None else ls.openness(t) for t in names), default=0.0)
            if names:
                labels |= names
                values.append(value)
            break
    return ",".join(sorted(labels)), min(values, default=0.0)


def descend(rest, level):
    """or, and, with; names and openness. IndexError for what is no expression."""
    if level == 4:
        t = rest.pop(0)
        if t == "(":
            got = descend(rest, 1)
            if rest.pop(0) != ")":
                raise IndexError
            return got
        if t in ("and", "or", "with", ")"):
            raise IndexError
        return {t}, 0.5 if ls.openness(t) is None else ls.openness(t)
    got = descend(rest, level + 1)
    while rest and rest[0] == ("or", "and", "with")[level - 1]:
        rest.pop(0)
        right = descend(rest, level + 1)
        if level == 3:
            got = got[0], got[1] + (1 - got[1]) / 2
        else:
            got = got[0] | right[0], (max if level == 1 else min)(got[1], right[1])
    return got


def test_labels_and_scores():
    rng = random.Random(8)
    bits = [*ls.NOTICES, *ls.BASE_PHRASES, "the", "creative commons", "license", "noncommercial", "version 3"]
    terms = ["MIT", "GPL-3.0-only", "(", ")", "AND", "OR", "WITH", "and", "Classpath-exception-2.0", "CC-BY-NC-4.0", "this", "X-1.0"]
    a = ls.automaton()
    for _ in range(3000):
        text = " ".join(rng.choice(bits).title() for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.7:
            text += "\n# SPDX-License-Identifier: " + " ".join(rng.choice(terms) for _ in range(rng.randint(0, 7))) + "\nrest"
        got = ls.scan(text, a)
        assert (got[5], pytest.approx(got[6])) == told(text), text


def test_longer_notices_win():
    a = ls.automaton()
    assert ls.scan("Creative Commons Attribution-NonCommercial 4.0", a)[5:] == ("cc-by-nc", 0.2)
    assert ls.scan("Creative Commons Attribution 4.0", a)[5:] == ("cc-by", 0.9)


def test_query(spark):
    got = op6_license_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(tuple(r)[1:6] == brute(texts[r["doc_id"]]) for r in got)
