"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Every kind is one regular expression. Splitting a text at its matches gives the pieces between them, so the running
sum of piece and match lengths is each match's code point offset; no Python runs. Base kinds (email, ip, card,
phone) follow the contract: leftmost non-overlapping, a failing match is dropped without a retry. The method adds
IBANs (mod 97) and dashed social security numbers; those need a score of at least `MIN_SCORE`.

Patterns are possessive or anchored at the start of a run, so very long runs of digits, letters or dotted names
take linear time and no deep recursion. Offsets are running sums taken in chunks, and context is read from segments of
the text, so that a text of very many matches takes time in proportion to its length, too.

Edge cases: null text counts as empty (no spans); repeated rows are judged on their own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import let

MIN_SCORE = 0.5
CONTEXT_CHARS = 40
SEGMENT = 512               # characters of text that context is looked up in (more than CONTEXT_CHARS)
CHUNK = 512                 # matches whose offsets are summed at once


@dataclass(frozen=True)
class Kind:
    """`score`: what a confirmed match has by itself; `context`: words near it that add 0.3; `base`: kept at any
    score. `hint`: a cheap pattern without which a text holds no match."""

    name: str
    regex: str
    score: float
    context: str
    hint: str
    base: bool = True


LOCAL = "[A-Za-z0-9._%+-]"
KINDS = [
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         "mail|contact|write|address", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "host|server|address|login|ip", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.8, "card|visa|credit|payment|account", "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "call|phone|tel|mobile|fax", r"\+[0-9]"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+\b", 0.8,
         "iban|bank|account|transfer", "[A-Z]{2}[0-9]{2}", base=False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.3, "ssn|social|security|tax", "[0-9]-[0-9]", base=False),
]
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """The Luhn sum of a string of ASCII digits is a multiple of ten."""
    def add(total, pair):
        doubled = F.when(pair.i % 2 == 1, pair.d * 2).otherwise(pair.d)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
                       lambda c, i: F.struct((F.ascii(c) - 48).alias("d"), i.alias("i")))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10..35, remainder 1 by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(
        F.ascii(c) >= 65, (acc * 100 + value(c)) % 97).otherwise((acc * 10 + value(c)) % 97))
    return (rest == 1) & F.length(plain).between(15, 34)


def confirmed(kind: str, m: Column) -> Column:
    """The validator of a kind on matched text."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3)
                        & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn_ok(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97_ok(m)
    return F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def _running(sizes: Column) -> Column:
    """The sum of all earlier elements, for each element of an int array (a bound one). An array that grows by appending
    is copied at each step, so sums run inside chunks of `CHUNK` elements, and over the chunks' totals."""
    def run(values: Column, start: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), none.alias("out")), step)["out"]

    chunk = lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK))
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    places = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int"))
    before = run(F.transform(places, lambda i: total(chunk(i))), F.lit(0))
    return F.flatten(F.zip_with(places, before, lambda i, at: run(chunk(i), at)))


def _around(segments: Column, at: Column, left: int, right: int) -> Column:
    """`left` characters before place `at` of the text and `right` after it, from its segments."""
    seg = F.floor(at / SEGMENT).cast("int")
    near = F.concat(*[F.coalesce(F.get(segments, seg + i), F.lit("")) for i in (-1, 0, 1)])
    mid = at - F.greatest(seg - 1, F.lit(0)) * SEGMENT
    start = F.greatest(mid - left, F.lit(0))
    return F.substr(near, start + 1, mid - start + right)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, by start: struct(start, kind, end, score)."""
    none = F.from_json(F.lit("[]"), SPAN)
    found = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0))
    parts = F.struct(found.alias("found"), F.split(text, kind.regex, -1).alias("pieces"),
                     # context comes from a few segments of the text, not from its start
                     F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)).alias("segments"))

    def span(m: Column, start: Column, segments: Column) -> Column:
        end = start + F.length(m)
        near = F.lower(F.concat(_around(segments, start, CONTEXT_CHARS, 0), m, _around(segments, end, 0, CONTEXT_CHARS)))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0))
        good = confirmed(kind.name, m)
        if not kind.base:
            good = good & (score >= MIN_SCORE)
        return F.when(good, F.struct(start.cast("int").alias("start"), F.lit(ORDER[kind.name]).alias("kind"),
                                     end.cast("int").alias("end"), score.alias("score")))

    def spans(p: Column) -> Column:
        # each match starts after the pieces and matches before it, and its own piece
        gaps = F.transform(F.slice(p["pieces"], 1, F.size(p["found"])), F.length)
        starts = let(F.zip_with(gaps, p["found"], lambda g, m: g + F.length(m)),
                     lambda sizes: F.zip_with(gaps, _running(sizes), lambda g, at: at + g))
        return F.filter(F.zip_with(p["found"], starts, lambda m, at: span(m, at, p["segments"])), lambda s: s.isNotNull())

    has = text.rlike(kind.hint)
    return F.when(has, let(parts, lambda p: F.when(F.size(p["found"]) > 0, spans(p)).otherwise(none))).otherwise(none)


def find_pii(docs: DataFrame, kinds: list[Kind] | None = None) -> DataFrame:
    """All columns of `docs` plus __pii: spans struct(start, kind, end, score) by start, then kind as listed."""
    kinds = KINDS if kinds is None else kinds
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("__pii", F.array_sort(F.concat(*[spans_of(text, k) for k in kinds])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == ORDER[kind])).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the spans' order."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
