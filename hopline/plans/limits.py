"""Size bounds behind every broadcast and every collect in the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Row bounds for plan-time choices.

    The bounded tables hold a handful of fixed-width columns (ids, counts,
    depths), so a row bound is also a byte bound: a million broadcast rows stay
    under roughly 100 MB on each executor.
    """

    #: Key sets up to this size are sent to the scan as a literal ``IN`` list.
    literal_rows: int = 1_000
    #: Tables up to this size may be broadcast.
    broadcast_rows: int = 1_000_000
    #: A key is a hub when it holds more than 1/hub_share of all rows, so there
    #: are never more than ``hub_share`` hubs.
    hub_share: int = 100_000
    #: ... and at least this many rows; smaller groups fit in one task.
    hub_rows: int = 1_000_000
    #: Groups up to this size may be sorted inside one task.
    group_rows: int = 1_000_000
    #: Query vectors in one block.
    query_rows: int = 20_000
    #: Bytes of vectors in one block of queries or of corpus rows.
    block_bytes: int = 32_000_000


DEFAULT_LIMITS = Limits()
