"""Reproducible randomness: every draw is a hash of the row key, so it does not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_column

HASH_BITS = 60


def row_hash(keys: Sequence[str | Column], seed: int | Column = 0, method: str = "xxhash64") -> Column:
    """Non-negative 60-bit hash of the key columns and the seed.

    ``xxhash64`` is the fast default; ``md5`` gives the same numbers in any engine.
    """
    cols = [as_column(k) for k in keys]
    salt = seed if isinstance(seed, Column) else F.lit(seed)
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*cols, salt), 64 - HASH_BITS)
    if method == "md5":
        text = F.concat_ws("|", *[c.cast("string") for c in cols], salt.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")
    raise ValueError(f"unknown hash method: {method}")


def uniform(keys: Sequence[str | Column], seed: int | Column = 0, method: str = "xxhash64") -> Column:
    """Uniform draw in [0, 1), one per key."""
    return F.shiftright(row_hash(keys, seed, method), HASH_BITS - 52).cast("double") / F.lit(float(2**52))


def standard_normal(keys: Sequence[str | Column], seed: int | Column = 0, method: str = "xxhash64") -> Column:
    """Standard normal draw by the Box-Muller transform of two uniform draws."""
    salt = seed if isinstance(seed, Column) else F.lit(seed)
    u1 = uniform([*keys, F.lit("radius")], salt, method)
    u2 = uniform([*keys, F.lit("angle")], salt, method)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)
