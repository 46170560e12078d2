"""Reproducible pseudo-random columns, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 12 hex digits of an MD5 digest make one 48-bit draw.
HEX_DIGITS = 12
DRAW_SPAN = 1 << 48


def uniform_int(key: Column, seed: int, stream: str) -> Column:
    """A uniform integer in ``[0, 2**48)`` for each key."""
    text = F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(stream))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def uniform_real(key: Column, seed: int, stream: str) -> Column:
    """A uniform double in ``[0, 1)`` for each key."""
    return uniform_int(key, seed, stream) / F.lit(float(DRAW_SPAN))
