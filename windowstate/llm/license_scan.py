"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the and/or/with expressions that tags carry.

Texts are scanned whole, in their words (0-9, a-z, non-ASCII, A-Z lower-cased) joined by single spaces, so a phrase
matches however it is wrapped or punctuated; overlapping places all count.

Score: how openly the found licences let a text be used, 0 to 1. Within an expression `or` takes the better side,
`and` the worse, `with` (an exception) half of what is missing to 1; over a document the worst finding counts. A
document without findings scores 0.

Edge cases: null or empty text has no words and no places; a malformed expression contributes the identifiers it
names and its worst one's openness; repeated rows are judged on their own; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm import rolling

# The contract's phrases and labels (fixed values).
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The method's own notices; where one begins another, only the longer one counts.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under the apache license": "apache-2.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "common development and distribution license": "cddl-1.0",
    "european union public licence": "eupl-1.2",
    "boost software license": "bsl-1.0",
    "do what the fuck you want to public license": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0-1.0",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "open data commons open database license": "odbl-1.0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Licence identifiers by how openly they let a text be used: a family's name stands for its versions, too, and
# `-only`, `-or-later` and `+` don't change it.
FAMILIES = {
    1.0: """0bsd afl apache apache-2 blueoak-1.0.0 bsd bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc0-1.0 fsfap isc mit
            mit-0 ncsa openssl php postgresql psf-2.0 public-domain python python-2.0 unlicense upl-1.0 vim w3c wtfpl x11
            zlib zpl""",
    0.9: "artistic artistic-2.0 cc-by odc-by ofl ofl-1.1",
    0.7: "cddl cecill-c cpl epl eupl ms-pl mpl",
    0.6: "cc-by-sa lgpl odbl osl",
    0.4: "cecill gfdl gpl",
    0.3: "agpl sspl",
    0.2: "cc-by-nc cc-by-nc-sa cc-by-nd cc-by-nc-nd busl elastic",
    0.0: "proprietary",
}
OPENNESS = {name: value for value, names in FAMILIES.items() for name in names.split()}
_VERSION = re.compile(r"(-only|-or-later|\+)$")
UNKNOWN = 0.5
BINDS = {"or": 1, "and": 2, "with": 3}
_TAG_LINE = re.compile(r"spdx[\W_]+license[\W_]+identifier[^A-Za-z0-9(\n]*([^\n]*)", re.IGNORECASE)
_SHAPED = re.compile(r"[a-z0-9.+]+(-[a-z0-9.+]+)*-v?\d[\d.]*[+]?(-only|-or-later)?|licenseref-.+|.+-exception(-.+)?")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")


def openness(name: str) -> float | None:
    """Of an identifier in lower case; None if it is unknown."""
    name = _VERSION.sub("", name)
    while name not in OPENNESS and "-" in name and name.rsplit("-", 1)[1].strip("v.0123456789") == "":
        name = name.rsplit("-", 1)[0]
    return OPENNESS.get(name)


def is_operand(token: str) -> bool:
    """A known licence, or what is shaped like an identifier: a name with a version, a reference, an exception."""
    return openness(token) is not None or _SHAPED.fullmatch(token) is not None


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: infix tokens (lower case) to postfix order; None if malformed."""
    out, stack, operand = [], [], False
    for t in tokens:
        if t in BINDS:
            if not operand:
                return None
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def expression_tokens(line: str) -> list[str]:
    """Tokens of the longest start of the line that reads as an expression: it ends where two operands meet, and at a
    word that is no licence."""
    tokens, operand = [], False
    for t in _TOKEN.findall(line):
        t = t.lower().rstrip(".")
        if t not in BINDS and t not in "()" and (operand or not is_operand(t)):
            break
        operand = t not in BINDS and t != "("
        tokens.append(t)
    while tokens and (tokens[-1] in BINDS or tokens[-1] == "("):
        tokens.pop()
    return tokens


def _value(name: str) -> float:
    known = openness(name)
    return UNKNOWN if known is None else known


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """(licence identifiers, openness) of an expression."""
    order = postfix(tokens)
    if order is None:
        ids = {t for t in tokens if t not in BINDS and t not in "()"}
        return ids, min((_value(t) for t in ids), default=0.0)
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t not in BINDS:
            stack.append(({t}, _value(t)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left, a + (1 - a) / 2))
        else:
            stack.append((left | right, max(a, b) if t == "or" else min(a, b)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, so that they match whole words; values are (kind, label, phrase length)."""
    a = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase)))
    a.make_automaton()
    return a


def scan(text: str | None, a: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = rolling.alnum_words(text)
    # latin-1 keeps one character a byte; phrases are ASCII, so matches are the same
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, more, places, values, tagged = set(), set(), [], [], False
    notices: dict[int, tuple[int, str]] = {}                # the longest notice from each place
    for end, (kind, label, length) in a.iter(joined):
        if kind == "base":
            places.append(end - length)
            base.add(label)
            values.append(_value(label))
        elif kind == "notice":
            notices[end - length] = max(notices.get(end - length, (0, "")), (length, label))
        else:
            tagged = True
    for _, label in notices.values():
        more.add(label)
        values.append(_value(label))
    if tagged:
        for m in _TAG_LINE.finditer(text):
            ids, value = evaluate(expression_tokens(m[1]))
            if ids:
                more |= ids
                values.append(value)
    # a place's word number is the number of spaces before its first letter, less the leading one
    at = (lambda p: joined.count(" ", 0, p) - 1)
    return (len(words), len(places), at(min(places)) if places else None, at(max(places)) if places else None,
            ",".join(sorted(base)), ",".join(sorted(base | more)), min(values, default=0.0))


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """All columns of `docs` plus __license, a struct of FIELDS."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton()
        for text in texts:
            got = pd.DataFrame([scan(t, a) for t in text], columns=names)
            for c in ("first_word", "last_word"):
                got[c] = got[c].astype("Int64")
            yield got

    return docs.withColumn("__license", F.pandas_udf(run, FIELDS)(F.col("text")))
