"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words, as a regular expression for Java, Python and DuckDB alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``body(*values)`` with each value computed once."""

    def bind(done: list[Column], rest: list[Column]) -> Column:
        if not rest:
            return body(*done)
        return let(rest[0], lambda x: bind([*done, x], rest[1:]))

    return bind([], values)


def text_of(column: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def words_of(column: Column, separator: str = SPACE) -> Column:
    """The words in order; a text without words gives an empty array."""
    return F.array_remove(F.split(column, separator), "")


def total(array: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum over an array, as a long."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + of(x).cast("long"))


def where(array: Column, test: Callable[[Column], Column]) -> Column:
    """Indexes (from 0) of the elements that pass ``test``."""
    marked = F.transform(array, lambda x, i: F.when(test(x), i).otherwise(F.lit(-1)))
    return F.array_remove(marked, -1)
