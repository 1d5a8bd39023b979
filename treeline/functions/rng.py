"""Deterministic randomness: a uniform number is a hash of a key, so it does not depend on row order or plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52


def hash52(*parts: Column | int | str, portable: bool = True) -> Column:
    """An integer below 2**52. ``portable`` uses md5 of the parts joined by ``:``, which other engines can compute; else xxhash64, which is faster."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if portable:
        return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - _BITS)


def uniform(*parts: Column | int | str, portable: bool = True) -> Column:
    """A number in [0, 1)."""
    return hash52(*parts, portable=portable).cast("double") / F.lit(float(1 << _BITS))


def signed_uniform(*parts: Column | int | str, portable: bool = True) -> Column:
    """A number in (-1, 1]."""
    return (hash52(*parts, portable=portable) + 1).cast("double") / F.lit(float(1 << (_BITS - 1))) - F.lit(1.0)
