"""Deterministic pseudo-random values from text seeds.

A seed hashes to an integer in [0, 2**32 - 1]. Two samplers exist and do not agree row
for row: ``modulo`` picks by remainder, ``scaled`` stretches the fraction over the range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_MAX = 4294967295.0


def _seed(seed: Column | str) -> Column:
    return F.col(seed) if isinstance(seed, str) else seed


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def seeded(prefix: str, *parts: Column | str) -> Column:
    """Text seed: a literal prefix followed by the parts joined with ``-``."""
    return F.concat(F.lit(prefix), F.concat_ws("-", *[_seed(p).cast("string") for p in parts]))


def hash32(seed: Column | str) -> Column:
    """First 32 bits of SHA-256 as BIGINT."""
    return F.conv(F.substring(F.sha2(_seed(seed), 256), 1, 8), 16, 10).cast("long")


def hash_fraction(seed: Column | str) -> Column:
    return hash32(seed).cast("double") / F.lit(HASH_MAX)


def hash_uniform(seed: Column | str, lo, hi) -> Column:
    """Double in [lo, hi]."""
    lo, hi = _value(lo), _value(hi)
    return lo + hash_fraction(seed) * (hi - lo)


def hash_int(seed: Column | str, lo, hi, mode: str = "modulo") -> Column:
    """INT in [lo, hi], both ends included."""
    lo, hi = _value(lo), _value(hi)
    if mode == "modulo":
        return (lo + hash32(seed) % (hi - lo + 1)).cast("int")
    if mode == "scaled":
        return hash_uniform(seed, lo, hi + F.lit(0.999)).cast("int")
    raise ValueError(f"unknown sampler {mode!r}")


def pick(index: Column, options: Sequence) -> Column:
    """The option at a 0-based index."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def hash_choice(seed: Column | str, options: Sequence, mode: str = "modulo") -> Column:
    return pick(hash_int(seed, 0, len(options) - 1, mode), options)


def hash_date(seed: Column | str, start, end, mode: str = "modulo") -> Column:
    """DATE in [start, end]; both are DATE columns."""
    span = F.greatest(F.lit(0), F.date_diff(end, start))
    return F.date_add(start, hash_int(seed, F.lit(0), span, mode))


def hash_weighted(
    seed: Column | str, options: Sequence, weights: Sequence[int], mode: str = "modulo", modulus: int | None = None
) -> Column:
    """Weighted pick.

    ``modulo``: the remainder by the total weight, or by a given ``modulus``, against integer
    running totals, the same as an array with every option repeated by its weight; a remainder
    past the total takes the last option. ``scaled``: the fraction against cumulative shares.
    """
    if mode == "modulo":
        position = hash32(seed) % (modulus or sum(weights))
        hits = [position < total for total in accumulate(weights)]
    elif mode == "scaled":
        total = sum(weights)
        fraction = hash_fraction(seed)
        hits = [fraction <= F.lit(share) for share in accumulate(w / total for w in weights)]
    else:
        raise ValueError(f"unknown sampler {mode!r}")
    chosen = F.when(hits[0], F.lit(options[0]))
    for option, hit in zip(options[1:-1], hits[1:-1]):
        chosen = chosen.when(hit, F.lit(option))
    return chosen.otherwise(F.lit(options[-1]))
