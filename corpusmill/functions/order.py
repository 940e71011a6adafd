"""Seeded orders and picks that any engine with md5 gives alike."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """32 hex digits whose order is a pseudo-random permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def pick(key: Column, span: Column, seed: int = 42, tag: str = "") -> Column:
    """A whole number from 0 to span - 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), span)
