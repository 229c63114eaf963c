"""Reproducible randomness: a hash of (seed, id) does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 8  # hex digits read from the hash for a number in [0, 1)


def hash_order(seed: int | str, *ids: Column) -> Column:
    """A 32-digit hex text whose order is a seeded shuffle of the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_integer(digest: Column) -> Column:
    """The leading 32 bits of a digest as a bigint."""
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint")


def hash_unit(digest: Column) -> Column:
    """The leading 32 bits of a digest as a double in [0, 1)."""
    return hash_integer(digest) / F.lit(float(16**DIGITS))


def hash_slot(digest: Column, n: Column | int) -> Column:
    """The leading 32 bits of a digest as an integer in [0, n)."""
    return hash_integer(digest) % (n if isinstance(n, Column) else F.lit(n))
