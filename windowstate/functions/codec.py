"""Text codecs of the key stream and of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: must equal the reference's wire formats ----
# Strict decimal long: optional sign then ASCII digits, nothing else (no spaces, no exponent, no hex).
# \A and \z anchor the whole string; `$` would also match before a trailing newline.
LONG_PATTERN = r"\A[+-]?[0-9]+\z"
# Value a record decodes to when it is not a decimal long (null, empty, spaces, 1.5, overflow ...).
INVALID_KEY = -1
# Result pair text: '(' key ',' count ')'
PAIR_OPEN, PAIR_SEP, PAIR_CLOSE = "(", ",", ")"
# Lookup answers: 'StateFound(key: K, value: V)' and 'StateNotFound(key: K)'
FOUND_OPEN, FOUND_VALUE, NOT_FOUND_OPEN, ANSWER_CLOSE = "StateFound(key: ", ", value: ", "StateNotFound(key: ", ")"
# -----------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_long(text: Column | str, invalid: int | None = INVALID_KEY) -> Column:
    """Decimal text (or UTF-8 bytes) -> bigint. Anything unparsable, including overflow, becomes `invalid`
    (default -1, mixed with genuine -1 values; pass invalid=None to get null and filter those rows).
    Digits are ASCII only; the reference's parser would also accept other Unicode decimal digits."""
    s = _c(text).cast("string")
    parsed = F.when(s.rlike(LONG_PATTERN), s.try_cast("bigint"))
    return parsed if invalid is None else F.coalesce(parsed, F.lit(invalid).cast("bigint"))


def long_text(value: Column | str) -> Column:
    """Bigint -> decimal text."""
    return _c(value).cast("bigint").cast("string")


def pair_text(key: Column | str, n: Column | str) -> Column:
    """An emitted (key, count) pair rendered as text, '(key,count)'."""
    return F.concat(F.lit(PAIR_OPEN), _c(key).cast("string"), F.lit(PAIR_SEP), _c(n).cast("string"),
                    F.lit(PAIR_CLOSE))


def with_one(key: Column | str = "key") -> list[Column]:
    """Pair each key with a constant 1 (never read by the count, which counts rows)."""
    return [_c(key).alias("key"), F.lit(1).cast("bigint").alias("one")]


def answer_text(key: Column | str, n: Column | str, found: Column | str) -> Column:
    """Render a lookup answer: 'StateFound(key: K, value: V)' or 'StateNotFound(key: K)'."""
    k = _c(key).cast("string")
    return F.when(
        _c(found), F.concat(F.lit(FOUND_OPEN), k, F.lit(FOUND_VALUE), _c(n).cast("string"), F.lit(ANSWER_CLOSE))
    ).otherwise(F.concat(F.lit(NOT_FOUND_OPEN), k, F.lit(ANSWER_CLOSE)))
