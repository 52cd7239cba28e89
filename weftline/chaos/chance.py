"""Hash-based chance as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def draw(seed: int, what: str, key: Column) -> Column:
    """A whole number below 2**32: the first eight hex digits of md5("seed|what|key")."""
    text = F.concat(F.lit(f"{seed}|{what}|"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int, what: str, key: Column) -> Column:
    return draw(seed, what, key) / F.lit(float(SPAN))


def happens(seed: int, what: str, key: Column, probability: float) -> Column:
    return draw(seed, what, key) < int(probability * SPAN)


def choose(seed: int, what: str, key: Column, options: list[Column]) -> Column:
    """One of the options, all as likely."""
    return F.array(*options)[(draw(seed, what, key) % len(options)).cast("int")]
