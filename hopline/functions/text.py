"""Labels and rounding of result records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem_engine(stem: Column) -> Column:
    """``engine`` of an ``engine_size`` stem: everything before the last underscore."""
    return F.regexp_extract(stem, r"^(.*)_([^_]+)$", 1)


def stem_size(stem: Column) -> Column:
    """``size`` of an ``engine_size`` stem: everything after the last underscore."""
    return F.regexp_extract(stem, r"^(.*)_([^_]+)$", 2)


def round_stat(value: Column, digits: int = 4) -> Column:
    """A statistic as it is reported; ties go away from zero on the decimal form."""
    return F.round(value, digits)
