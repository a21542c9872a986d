"""Key -> partition function (P6) of the reference's lookup routing.

hash = murmur-style finaliser of Java's Long.hashCode(key), made non-negative; partition = hash % n.
It is *not* Spark's hash(): different seed and mixing. 32-bit unsigned arithmetic is carried in bigint with masks,
and multiplications are split into 16-bit halves so no intermediate exceeds 2^49 (ANSI mode raises on overflow).

Every step reads its input more than once, so the steps are separate projections: one nested Column would grow
exponentially. Catalyst keeps them as separate Project nodes (it does not collapse non-cheap expressions
referenced twice) and whole-stage codegen fuses them into one loop. A predicate on the result (explicit, or
inferred from a join on the partition column) would still be pushed down through the chain and re-inline every
step, so the chain ends in an `observe()` node (CollectMetrics), which predicates are not pushed through.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: must equal the reference's routing function ----
# multiply constants, in order of application
C1 = 0xCC9E2D51
C2 = 0x1B873593
C3 = 0xE6546B64
C4 = 0x85EBCA6B
C5 = 0xC2B2AE35
# rotations after the first and second multiply; the xor applied after the third multiply
ROT1 = 15
ROT2 = 13
XOR_LEN = 4
# right shifts of the finaliser
FINAL_SHIFTS = (16, 13, 16)
# --------------------------------------------------------------------

MASK32 = 0xFFFFFFFF
TWO32 = 1 << 32
TWO31 = 1 << 31


def _mul32(x: Column, c: int) -> Column:
    lo, hi = c & 0xFFFF, c >> 16
    return ((x * F.lit(lo)) + F.shiftleft((x * F.lit(hi)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))


def _rotl32(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseOR(F.shiftright(x, 32 - r)).bitwiseAND(F.lit(MASK32))


def _xorshift(x: Column, s: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, s))


def key_fold(key: Column | str) -> Column:
    """Java Long.hashCode as an unsigned 32-bit value: low word xor high word."""
    k = F.col(key) if isinstance(key, str) else key
    k = k.cast("bigint")
    return k.bitwiseAND(F.lit(MASK32)).bitwiseXOR(F.shiftright(k, 32).bitwiseAND(F.lit(MASK32)))


_STEPS = [
    lambda x: _mul32(x, C1),
    lambda x: _rotl32(x, ROT1),
    lambda x: _mul32(x, C2),
    lambda x: _rotl32(x, ROT2),
    lambda x: _mul32(x, C3),
    lambda x: x.bitwiseXOR(F.lit(XOR_LEN)),
    lambda x: _xorshift(x, FINAL_SHIFTS[0]),
    lambda x: _mul32(x, C4),
    lambda x: _xorshift(x, FINAL_SHIFTS[1]),
    lambda x: _mul32(x, C5),
    lambda x: _xorshift(x, FINAL_SHIFTS[2]),
]


def murmur_mix(df: DataFrame, fold_col: str, out: str) -> DataFrame:
    """Apply the mix to an unsigned 32-bit column; `out` is the non-negative int hash (bigint)."""
    tmp = f"__{out}_h"
    df = df.withColumn(tmp, F.col(fold_col))
    for step in _STEPS:
        df = df.withColumn(tmp, step(F.col(tmp)))
    signed = F.when(F.col(tmp) >= F.lit(TWO31), F.col(tmp) - F.lit(TWO32)).otherwise(F.col(tmp))
    df = df.withColumn(tmp, signed)
    # non-negative: keep, negate, and Integer.MIN_VALUE -> 0
    df = df.withColumn(out, F.when(F.col(tmp) >= 0, F.col(tmp)).when(F.col(tmp) != F.lit(-TWO31), -F.col(tmp))
                       .otherwise(F.lit(0)).cast("bigint"))
    return df.drop(tmp)


def key_partition(df: DataFrame, key: str, n_partitions: int, part_col: str = "partition",
                  hash_col: str | None = None) -> DataFrame:
    """Add `part_col` (int in [0, n)) = routing partition of `key` among `n_partitions` (an explicit argument,
    never derived from the cluster size). Optionally keep the hash in `hash_col`."""
    if n_partitions <= 0:
        raise ValueError("n_partitions must be positive")
    h = hash_col or f"__{part_col}_hash"
    fold = f"__{part_col}_fold"
    df = murmur_mix(df.withColumn(fold, key_fold(key)), fold, h).drop(fold)
    df = df.withColumn(part_col, (F.col(h) % F.lit(n_partitions)).cast("int"))
    df = df if hash_col else df.drop(h)
    return df.observe(f"key_partition_{next(_BARRIER_IDS)}", F.count(F.lit(1)).alias("rows"))


_BARRIER_IDS = itertools.count()
