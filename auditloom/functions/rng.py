"""Randomness by hash order: the same draws whatever the partitioning, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | Column, tag: str, *columns: str | Column) -> Column:
    """Text to sort by for a seeded permutation or subsample."""
    return F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.lit(tag), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def _part(key: Column, start: int) -> Column:
    return F.conv(F.substring(key, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed: int, tag: str, *columns: str | Column) -> Column:
    """In [0, 1)."""
    return _part(order_key(seed, tag, *columns), 1)


def normal(seed: int, tag: str, *columns: str | Column) -> Column:
    """Standard normal by Box and Muller's transform of two uniforms of one hash."""
    key = order_key(seed, tag, *columns)
    first, second = F.greatest(_part(key, 1), F.lit(1e-12)), _part(key, 9)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(6.283185307179586) * second)


def whole(seed: int, tag: str, bound: Column, *columns: str | Column) -> Column:
    """A whole number from 0 to ``bound`` - 1."""
    return F.least(F.floor(uniform(seed, tag, *columns) * bound), bound - 1).cast("int")
