"""Epoch-millisecond arithmetic."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970-01-01 UTC of a timestamp column.

    A timestamp without time zone is read as UTC, whatever the session's zone.
    """
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.expr(
            f"cast(cast((`{name}` - timestamp_ntz'1970-01-01 00:00:00') as interval second)"
            " as decimal(20,6))"
        )
        return F.floor(seconds * 1000).cast("long")
    return F.unix_millis(F.col(name))


def instant(df: DataFrame, name: str, ms: int) -> Column:
    """An epoch millisecond as a value of the type of a timestamp column."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        moment = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
        return F.expr(f"timestamp_ntz'{moment.isoformat(' ')}'")
    return F.timestamp_millis(F.lit(ms))


def third_window(base: int, span: int) -> tuple[int, int]:
    """The middle third of ``[base, base + span)``, in whole milliseconds."""
    return base + span // 3, base + 2 * span // 3


def third_columns(base: Column, span: Column) -> tuple[Column, Column]:
    """:func:`third_window` as columns, for spans that are themselves data."""
    three = F.lit(3).cast("long")
    return (
        base + F.call_function("div", span, three),
        base + F.call_function("div", span * 2, three),
    )
