"""Seeded keys and content hashes that give the same text in any SQL engine."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_DIGITS = 4
BUCKETS = 16**BUCKET_DIGITS


def stable_key(seed, *cols: Column) -> Column:
    """md5 of the seed and the columns: a reproducible random key per row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def order_key(seed, col: Column) -> Column:
    """Sort text that is random by seed and unique as long as ``col`` is unique."""
    return F.concat(stable_key(seed, col), F.lit("|"), col.cast("string"))


def key_bucket(key: Column, digits: int = BUCKET_DIGITS) -> Column:
    """Leading hex digits of a key as a number: an order-preserving even histogram bin."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def uniform(key: Column, slot: int = 0) -> Column:
    """Uniform number in (0, 1) from eight hex digits of a key (slots 0 to 3)."""
    return (F.conv(F.substring(key, 1 + 8 * slot, 8), 16, 10).cast("double") + 0.5) / F.lit(
        float(2**32)
    )


def whole_below(key: Column, n: Column | int) -> Column:
    """Whole number from 0 to ``n - 1`` from fifteen hex digits (60 bits) of a key."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % n


# Rounds of the permutation, and repeats after which a position beyond ``n`` is out of the question:
# fewer than ``sqrt(n)`` positions lie beyond, so a repeat is needed with chance ``1 / sqrt(n)``.
ROUNDS, WALK = 4, 64


def permuted(position: Column, n: int, seed, *cols: Column) -> Column:
    """Place of a position from 0 to ``n - 1`` in a permutation keyed by the seed and the columns.

    A Feistel network on ``a * b`` cells, ``a`` and ``b`` about ``sqrt(n)``: each round moves one half by
    a keyed number of the other, so every round is one to one. Positions beyond ``n`` walk on along
    their cycle. Distinct positions give distinct places without any pool of rows.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = -(-max(n, 1) // a)

    def once(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            left = F.when(i % 2 == 0, (s["l"] + whole_below(stable_key(seed, *cols, i, s["r"]), a)) % a)
            right = F.when(i % 2 == 1, (s["r"] + whole_below(stable_key(seed, *cols, i, s["l"]), b)) % b)
            return F.struct(F.coalesce(left, s["l"]).alias("l"), F.coalesce(right, s["r"]).alias("r"))

        halves = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))
        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(rounds, halves, turn, lambda s: s["l"] + s["r"] * a)

    steps = min(a * b - n, WALK)
    first = once(position.cast("long"))
    if steps <= 0:
        return first
    again = F.array(*[F.lit(i) for i in range(steps)])
    return F.aggregate(again, first, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def normal(key: Column) -> Column:
    """Standard normal number from two uniform slots of a key (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(key, 0))) * F.cos(
        F.lit(2.0) * F.pi() * uniform(key, 1)
    )


def content_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-insensitive table hash ``(n_rows, content_hash)``: one pass, one row.

    Every value is written with its length and a null as a dash, so different rows have different
    texts. The SHA-256 of a row is summed as four 64-bit numbers in decimals that do not overflow.
    """
    names = cols or df.columns

    def sized(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    digest = F.sha2(F.concat_ws("|", *[sized(c) for c in names]), 256)

    def lane(i: int) -> Column:
        number = F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(number), F.lit(0)).cast("string")

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws("-", *[lane(i) for i in range(4)]).alias("content_hash"),
    )


def params_fingerprint(params: dict, drop: tuple[str, ...] = ("root",)) -> Column:
    """SHA-256 of a parameter mapping with sorted keys, machine paths left out."""
    kept = {k: v for k, v in params.items() if k not in drop}
    return F.sha2(F.lit(json.dumps(kept, sort_keys=True, default=str)), 256)
