"""Seeded numbers that every engine with md5 computes alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scatter(*values: str | Column, seed: int) -> Column:
    """32 hexadecimal digits that depend on the values and the seed alone."""
    return F.md5(F.concat_ws(":", *[F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values], F.lit(str(seed))).cast("binary"))


def digits(scattered: Column, at: int, n: int) -> Column:
    """``n`` of its digits, from position ``at`` (0 is the first), as a whole number."""
    return F.conv(F.substring(scattered, at + 1, n), 16, 10).cast("long")
