"""What tasks do with Arrow batches of vectors: nearest rows, and normal draws.

The module is pickled by value, so executors need NumPy and PyArrow but not this
package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from hopline.functions.vectors import DISTANCE_DECIMALS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Products formed at a time when most rows are left out by them, and the first rows, which set bounds.
TILE, HEAD = 1_000_000, 1_024

#: Distance, in units of the last reported decimal, of rows that cannot be compared.
NO_DISTANCE = np.iinfo(np.int32).max

# Increment and multipliers of the SplitMix64 generator.
INCREMENT = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def matrix(column, dim: int) -> np.ndarray:
    """List column of ``dim``-long vectors as a double matrix, missing elements as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if flat.null_count:
        flat = flat.cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN."""
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    length[length == 0] = np.nan
    return rows / length[:, None]


def block_best(ids: np.ndarray, units: np.ndarray, queries: np.ndarray, k: int):
    """Per query, distances and ids of the ``k`` nearest rows of one block.

    ``ids`` must be sorted: one integer then orders by distance and by id, and no
    ties are left at the k-th place.
    """
    distance = np.rint((1.0 - queries @ units.T) * 10.0**DISTANCE_DECIMALS)
    steps = np.where(np.isnan(distance), NO_DISTANCE, distance).astype(np.int64)
    keys = steps * len(ids) + np.arange(len(ids))
    if k < len(ids):
        picked = np.argpartition(keys, k - 1, axis=1)[:, :k]
    else:
        picked = np.broadcast_to(np.arange(len(ids)), keys.shape)
    return np.take_along_axis(steps, picked, axis=1), ids[picked]


class Tops:
    """The ``k`` best rows one task has seen so far for each query.

    With ``distinct`` an id takes one place, with its least distance.
    """

    def __init__(self, queries: int, k: int, distinct: bool = False):
        self.steps = np.full((queries, k), NO_DISTANCE, dtype=np.int64)
        self.ids = np.zeros((queries, k), dtype=np.int64)
        self.distinct = distinct

    def add(self, at: np.ndarray, steps: np.ndarray, ids: np.ndarray) -> None:
        steps = np.concatenate([self.steps[at], steps], axis=1)
        ids = np.concatenate([self.ids[at], ids], axis=1)
        if self.distinct:
            order = np.lexsort((steps, ids), axis=-1)
            steps, ids = (np.take_along_axis(x, order, axis=1) for x in (steps, ids))
            steps[:, 1:][ids[:, 1:] == ids[:, :-1]] = NO_DISTANCE
        order = np.lexsort((ids, steps), axis=-1)[:, : self.steps.shape[1]]
        self.steps[at] = np.take_along_axis(steps, order, axis=1)
        self.ids[at] = np.take_along_axis(ids, order, axis=1)


class Nearest(Tops):
    """The ``k`` rows nearest to each of the caller's unit vectors, of all that were compared.

    A query's k-th distance so far bounds what is still of interest to it, and so does ``most``
    (in units of the last decimal) if it is given. Products in single precision, less what
    rounding can take from them, leave out nearly all rows; the others are compared in double.
    """

    def __init__(self, units: np.ndarray, k: int, most: np.ndarray | None = None, distinct: bool = False):
        super().__init__(len(units), k, distinct)
        self.units, self.single = units, units.astype(np.float32)
        self.most = np.full(len(units), NO_DISTANCE, dtype=np.int64) if most is None else most.copy()
        self.most[np.isnan(units).any(axis=1)] = -1

    def bounds(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.most[at], self.steps[at, -1])

    def compare(self, at: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Rows, sorted by id, with the queries ``at``. Few rows come first where bounds are missing."""
        single = units.astype(np.float32)
        length = np.einsum("ij,ij->i", units, units)
        longest = np.sqrt(length[~np.isnan(length)].max(initial=1.0))
        slack = (units.shape[1] + 8) * 2.0**-23 * longest
        rows = max(8 * HEAD, 512 * self.steps.shape[1])  # the more are kept, the more a merge costs
        first, width = 0, HEAD if (self.bounds(at) == NO_DISTANCE).any() else rows
        while first < len(ids):
            part = slice(first, first + width)
            each = max(1, TILE // min(width, len(ids) - first))
            for start in range(0, len(at), each):
                self._compare(at[start : start + each], ids[part], units[part], single[part], slack)
            first, width = first + width, min(rows, first + width)

    def _compare(self, at, ids, units, single, slack: float) -> None:
        bounds = self.bounds(at)
        least = 1.0 - (bounds + 1) / 10.0**DISTANCE_DECIMALS - slack
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        near = self.single[at] @ single.T >= least[:, None]
        if np.count_nonzero(near) > near.size // 16:  # no bounds yet, or very many equal distances
            self.add(at, *block_best(ids, units, self.units[at], self.steps.shape[1]))
            return
        own, row = np.divmod(np.flatnonzero(near), len(ids))
        steps = np.rint((1.0 - np.einsum("ij,ij->i", self.units[at[own]], units[row])) * 10.0**DISTANCE_DECIMALS)
        kept = np.flatnonzero(steps <= bounds[own])
        self.merge(at, own[kept], steps[kept].astype(np.int64), ids[row[kept]])

    def merge(self, at: np.ndarray, own: np.ndarray, steps: np.ndarray, ids: np.ndarray) -> None:
        """Single rows ``(steps, ids)``, each for the query ``at[own]``; ``own`` is sorted."""
        k = self.steps.shape[1]
        some, group = np.unique(own, return_inverse=True)
        to = at[some]
        group = np.concatenate([np.repeat(np.arange(len(some)), k), group])
        steps = np.concatenate([self.steps[to].ravel(), steps])
        ids = np.concatenate([self.ids[to].ravel(), ids])
        if self.distinct:
            order = np.lexsort((steps, ids, group))
            group, steps, ids = group[order], steps[order], ids[order]
            steps[1:][(ids[1:] == ids[:-1]) & (group[1:] == group[:-1])] = NO_DISTANCE
        order = np.lexsort((ids, group * 2**32 + steps))
        begin = np.searchsorted(group[order], np.arange(len(some)))
        best = order[begin[:, None] + np.arange(k)]
        self.steps[to], self.ids[to] = steps[best], ids[best]


def task_tops(query_ids, query_units, k: int, dim: int):
    """The function a task runs: corpus batches in, its best rows per query out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, units_of = query_ids.value, query_units.value
        everyone = np.arange(len(ids_of))
        tops = Nearest(units_of, k)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, units = ids[order], unit_rows(matrix(batch.column(1), dim))[order]
            tops.compare(everyone, ids, units)
        query_at, slot = np.nonzero(tops.steps < NO_DISTANCE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids_of[query_at]),
                pa.array(tops.ids[query_at, slot]),
                pa.array(tops.steps[query_at, slot] / 10.0**DISTANCE_DECIMALS),
            ],
            names=["query_id", "id", "distance"],
        )

    return run


def _best_rows(query_ids: np.ndarray, tops: Tops) -> pa.Table:
    query_at, slot = np.nonzero(tops.steps < NO_DISTANCE)
    return pa.table(
        {
            "query_id": pa.array(query_ids[query_at], pa.int64()),
            "id": pa.array(tops.ids[query_at, slot]),
            "distance": pa.array(tops.steps[query_at, slot] / 10.0**DISTANCE_DECIMALS),
        }
    )


def group_tops(k: int, dim: int):
    """The function of one group: its queries and its corpus rows in, the best rows per query out."""

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        query_ids = queries.column("query_id").to_numpy()
        tops = Tops(len(query_ids), k)
        if len(query_ids) and corpus.num_rows:
            tops = Nearest(unit_rows(matrix(queries.column("vector"), dim)), k)
            ids = corpus.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            units = unit_rows(matrix(corpus.column("vector"), dim))
            tops.compare(np.arange(len(query_ids)), ids[order], units[order])
        return _best_rows(query_ids, tops)

    return run


#: Pairs, or rows of codes, whose vectors are formed at a time.
SLICE = 65_536


def group_pairs(k: int, dim: int):
    """The function of one group: its queries, and its corpus rows and chosen pairs, in; the best
    pairs per query out. Pairs ``(query_id, id)`` have an empty vector, corpus rows no query."""

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        query_ids = queries.column("query_id").to_numpy()
        is_pair = held.column("query_id").is_valid()
        rows, pairs = held.filter(pc.invert(is_pair)), held.filter(is_pair)
        tops = Tops(len(query_ids), k)
        if len(query_ids) and rows.num_rows and pairs.num_rows:
            asked, units = (unit_rows(matrix(t.column("vector"), dim)) for t in (queries, rows))
            by_query, ids = np.argsort(query_ids, kind="stable"), rows.column("id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            query_of, id_of = (pairs.column(c).to_numpy() for c in ("query_id", "id"))
            at = np.searchsorted(query_ids, query_of, sorter=by_query)
            known = query_ids[by_query[np.minimum(at, len(query_ids) - 1)]] == query_of
            query_of, id_of = by_query[at[known]], id_of[known]
            first, last = (np.searchsorted(ids, id_of, side, sorter=by_id) for side in ("left", "right"))
            times = last - first  # an id may have several rows
            begin = np.cumsum(times) - times
            row_of = by_id[np.arange(times.sum()) + np.repeat(first - begin, times)]
            query_of = np.repeat(query_of, times)
            steps = np.empty(len(row_of))
            for start in range(0, len(row_of), SLICE):
                part = slice(start, start + SLICE)
                cosine = np.einsum("ij,ij->i", asked[query_of[part]], units[row_of[part]])
                steps[part] = np.rint((1.0 - cosine) * 10.0**DISTANCE_DECIMALS)
            usable = np.flatnonzero(~np.isnan(steps))
            order = usable[np.lexsort((ids[row_of[usable]], steps[usable], query_of[usable]))]
            group = query_of[order]
            nth = np.arange(len(order)) - np.searchsorted(group, group)
            order, group, nth = order[nth < k], group[nth < k], nth[nth < k]
            tops.steps[group, nth], tops.ids[group, nth] = steps[order], ids[row_of[order]]
        return _best_rows(query_ids, tops)

    return run


def task_pairs(dim: int):
    """The function a task runs: ``(query_id, asked, id, vector)`` in, their distances out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, rows = (unit_rows(matrix(batch.column(c), dim)) for c in (1, 3))
            steps = np.rint((1.0 - np.einsum("ij,ij->i", asked, rows)) * 10.0**DISTANCE_DECIMALS)
            usable = pa.array(np.flatnonzero(~np.isnan(steps)))
            distance = pa.array(steps / 10.0**DISTANCE_DECIMALS)
            yield pa.RecordBatch.from_arrays(
                [c.take(usable) for c in (batch.column(0), batch.column(2), distance)],
                names=["query_id", "id", "distance"],
            )

    return run


class Cells:
    """Centroids of the cells, and short codes for what a row differs from its centroid.

    A code has one byte per stretch of a vector: the number of the nearest of that
    stretch's ``values``, an array of (stretches, values, width).
    """

    def __init__(self, numbers: np.ndarray, centroids: np.ndarray, values: np.ndarray | None = None):
        self.numbers, self.centroids, self.values = numbers, centroids, values

    def stretches(self, rest: np.ndarray, parts: int) -> np.ndarray:
        return rest.reshape(len(rest), parts, -1)

    def encode(self, units: np.ndarray, cell_at: np.ndarray) -> np.ndarray:
        rest = self.stretches(units - self.centroids[cell_at], len(self.values))
        codes = np.empty(rest.shape[:2], dtype=np.uint8)
        for m, values in enumerate(self.values):
            codes[:, m] = np.argmin((values**2).sum(1) - 2.0 * rest[:, m] @ values.T, axis=1)
        return codes

    def decode(self, codes: np.ndarray, at: int) -> np.ndarray:
        """Near enough unit vectors of rows of codes, all of the cell at one place."""
        return self.centroids[at] + self.values[np.arange(len(self.values)), codes].reshape(len(codes), -1)

    def raw(self, column) -> np.ndarray:
        """A binary column of codes as rows of bytes."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset :]
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        return data[ends[0] : ends[len(column)]].reshape(len(column), len(self.values))

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """Per unit vector, the places of the ``n`` cells with the nearest centroids."""
        return np.argsort(-(units @ self.centroids.T), axis=1, kind="stable")[:, :n]


def group_code_tops(k: int, dim: int, cells, nprobe: int, distinct: bool):
    """The function of one group: its queries, and codes of rows of all cells, in; the best rows per query out.

    ``cells`` broadcasts what :class:`Cells` is made of. A query is compared with the rows of its
    ``nprobe`` nearest cells; what it has found in one bounds what is of interest in the next.
    """

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        query_ids = queries.column("query_id").to_numpy()
        tops = Tops(len(query_ids), k)
        if len(query_ids) and corpus.num_rows:
            known, units = Cells(*cells.value), unit_rows(matrix(queries.column("vector"), dim))
            tops = Nearest(units, k, distinct=distinct)
            probed = np.zeros((len(units), len(known.numbers)), dtype=bool)
            np.put_along_axis(probed, known.nearest(units, nprobe), True, axis=1)
            probed[np.isnan(units).any(axis=1)] = False
            ids, own = (corpus.column(c).to_numpy() for c in ("id", "cell"))
            codes, order = known.raw(corpus.column("vector")), np.lexsort((ids, own))
            for at, number in enumerate(known.numbers):
                first, last = (np.searchsorted(own, number, side, sorter=order) for side in ("left", "right"))
                wanted = np.flatnonzero(probed[:, at])
                for start in range(first, last if len(wanted) else first, SLICE):
                    rows = order[start : min(last, start + SLICE)]
                    tops.compare(wanted, ids[rows], known.decode(codes[rows], at))
        return _best_rows(query_ids, tops)

    return run


def task_code_tops(cells, unit, k: int):
    """The function a task runs: ``(id, vector: code, cell)`` in, its rows nearest to one query out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, known = Tops(1, k), Cells(*cells.value)
        for batch in batches:
            own = batch.column("cell").to_numpy()
            for cell in np.unique(own):
                part = batch.take(pa.array(np.flatnonzero(own == cell)))
                ids = part.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                at = np.flatnonzero(known.numbers == cell)[0]
                rows = known.decode(known.raw(part.column("vector")), at)[order]
                tops.add(np.zeros(1, dtype=np.int64), *block_best(ids[order], rows, unit, k))
        found = np.flatnonzero(tops.steps[0] < NO_DISTANCE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tops.ids[0, found]), pa.array(tops.steps[0, found] / 10.0**DISTANCE_DECIMALS)],
            names=["id", "distance"],
        )

    return run


def task_probes(cells, dim: int, nprobe: int):
    """The function a task runs: ``(query_id, vector)`` in, a row per query and probed cell out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells(*cells.value)
        numbers = known.numbers
        for batch in batches:
            units = unit_rows(matrix(batch.column(1), dim))
            choice = known.nearest(units, nprobe)
            usable = np.flatnonzero(~np.isnan(units).any(axis=1))
            at = pa.array(np.repeat(usable, choice.shape[1]))
            cell = pa.array(numbers[choice[usable].ravel()].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), cell], names=["query_id", "vector", "cell"]
            )

    return run


def _codes(codes: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    ends = pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, pa.py_buffer(codes.tobytes())])


def task_cells(cells, dim: int, no_cell: int, copies: int = 1, among=None):
    """The function a task runs: ``(id, embedding)`` in, ``(id, embedding, nth, code, cell)`` out.

    A row comes once for each of its ``copies`` nearest cells, numbered by ``nth``. With
    ``among`` a row, which then has further columns ``(nth, cell)``, goes to the nearest of
    the cells that replace its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells(*cells.value)
        for batch in batches:
            ids, vectors = batch.columns[:2]
            length = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fitting = np.flatnonzero(length == dim)
            units = unit_rows(matrix(vectors.take(pa.array(fitting)), dim))
            usable = ~np.isnan(units).any(axis=1)
            fitting, units = fitting[usable], units[usable]
            near = units @ known.centroids.T
            if among is None:
                rest = np.setdiff1d(np.arange(batch.num_rows), fitting)
                if copies == 1:
                    order = np.argmax(near, axis=1)[:, None]
                else:
                    order = np.argsort(-near, axis=1, kind="stable")[:, :copies]
                at, row = order.T.ravel(), np.tile(np.arange(len(fitting)), order.shape[1])
                nth = np.repeat(np.arange(order.shape[1]), len(fitting))
            else:
                rest = np.zeros(0, dtype=np.int64)
                old = batch.column(3).to_numpy()[fitting]
                allowed = np.array([[n in among[c] for n in known.numbers.tolist()] for c in sorted(among)])
                near[~allowed[np.searchsorted(sorted(among), old)]] = -np.inf
                at, row = np.argmax(near, axis=1), np.arange(len(fitting))
                nth = batch.column(2).to_numpy()[fitting]
            take = pa.array(np.concatenate([fitting[row], rest]))
            if known.values is None or not len(row):
                code = pa.nulls(len(take), pa.binary())
            else:
                code = _codes(known.encode(units[row], at))
                code = pa.concat_arrays([code, pa.nulls(len(rest), pa.binary())])
            cell = np.concatenate([known.numbers[at], np.full(len(rest), no_cell)]).astype(np.int32)
            nth = np.concatenate([nth, np.zeros(len(rest), dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), vectors.take(take), pa.array(nth), code, pa.array(cell)],
                names=["id", "embedding", "nth", "code", "cell"],
            )

    return run


def task_stretches(cells, dim: int, parts: int):
    """The function a task runs: ``(id, embedding)`` in, ``(part, rows)`` out: what is left of the
    rows without their centroids, stretch by stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells(*cells.value)
        for batch in batches:
            units = unit_rows(matrix(batch.column(1), dim))
            at = np.argmax(units @ known.centroids.T, axis=1)
            rest = known.stretches(units - known.centroids[at], parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(parts, dtype=np.int32)), pa.array([rest[:, m].tobytes() for m in range(parts)], pa.binary())],
                names=["part", "rows"],
            )

    return run


def means(rows: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """``n`` centres of ``rows`` by Lloyd's rounds, fewer if there are fewer rows."""
    start = np.random.default_rng(seed).permutation(len(rows))[:n]
    centres = rows[np.sort(start)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2.0 * rows @ centres.T, axis=1)
        held = np.bincount(own, minlength=len(centres))
        for d in range(rows.shape[1]):
            total = np.bincount(own, weights=rows[:, d], minlength=len(centres))
            centres[held > 0, d] = total[held > 0] / held[held > 0]
    return centres


def group_means(key: str, n: int, width: int, rounds: int = 10, seed: int = 42):
    """The function of one group of ``(key, rows)``: its centres, as one row ``(key, values)``."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist())).reshape(-1, width)
        values = means(rows, n, rounds, seed).ravel()
        return pa.table(
            {key: table.column(key).slice(0, 1).cast(pa.int32()), "values": pa.array([values.tolist()], pa.list_(pa.float64()))}
        )

    return run


def task_units(dim: int):
    """The function a task runs: ``(cell, embedding)`` in, ``(cell, rows)`` out: packed unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, units = batch.column(0).to_numpy(), unit_rows(matrix(batch.column(1), dim))
            cells = np.unique(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), pa.array([units[own == c].tobytes() for c in cells], pa.binary())],
                names=["cell", "rows"],
            )

    return run


def task_blocks(dim: int, most: int):
    """The function a task runs: ``(id, embedding, cell)`` by cell in, blocks of one cell out."""

    def block(cell: int, ids: list[np.ndarray], units: list[np.ndarray]) -> pa.RecordBatch:
        ids, units = np.concatenate(ids), np.concatenate(units)
        order = np.argsort(ids, kind="stable")
        middle = units.mean(axis=0)
        length = np.sqrt(middle @ middle)
        middle = middle / length if length > 0 else units[0]
        widest = np.arccos(np.clip(units @ middle, -1.0, 1.0)).max()
        values = [cell], [ids[order].tobytes()], [units[order].tobytes()], [middle.tobytes()], [widest]
        kinds = pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, kinds)], names=["cell", "ids", "rows", "middle", "widest"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, units = None, 0, [], []
        for batch in batches:
            own = batch.column(2).to_numpy()
            first = 0
            while first < len(own):
                if held and (own[first] != now or held == most):
                    yield block(now, ids, units)
                    held, ids, units = 0, [], []
                now = int(own[first])
                last = first + int(np.searchsorted(own[first:] != now, True))
                last = min(last, first + most - held)
                part = batch.slice(first, last - first)
                ids.append(part.column(0).to_numpy())
                units.append(unit_rows(matrix(part.column(1), dim)))
                held, first = held + last - first, last
        if held:
            yield block(now, ids, units)

    return run


#: Added to bounds before a block is skipped: rounding of reported distances and of angles.
SLACK = 2 * 10.0**-DISTANCE_DECIMALS


def task_block_tops(given, k: int, dim: int, count: bool = False):
    """The function a task runs: packed blocks in, its best rows per query of the caller out.

    ``given`` is a broadcast of ids, unit vectors, and either the only cell that each query
    is compared with or the bounds beyond which blocks are skipped. With ``count`` the pairs
    that are compared and all pairs come out instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, units_of, own, bounds = given.value
        most = None
        if bounds is not None:
            known = np.isfinite(bounds)
            most = np.full(len(ids_of), NO_DISTANCE, dtype=np.int64)
            most[known] = np.rint(bounds[known] * 10.0**DISTANCE_DECIMALS)
        tops = Nearest(units_of, k, most)
        compared = pairs = 0
        for batch in batches:
            for cell, ids, rows, middle, widest in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, dtype=np.int64)
                units = np.frombuffer(rows).reshape(len(ids), dim)
                if own is not None:
                    wanted = np.flatnonzero(own == cell)
                else:
                    angle = np.arccos(np.clip(units_of @ np.frombuffer(middle), -1.0, 1.0))
                    least = 1.0 - np.cos(np.maximum(0.0, angle - widest))
                    wanted = np.flatnonzero(least <= bounds + SLACK)
                compared += len(wanted) * len(ids)
                pairs += len(ids_of) * len(ids)
                if not count:
                    tops.compare(wanted, ids, units)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([compared]), pa.array([pairs])], names=["compared", "pairs"])
            return
        query_at, slot = np.nonzero(tops.steps < NO_DISTANCE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids_of[query_at]),
                pa.array(tops.ids[query_at, slot]),
                pa.array(tops.steps[query_at, slot] / 10.0**DISTANCE_DECIMALS),
            ],
            names=["query_id", "id", "distance"],
        )

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


def normal_rows(keys: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """``dim`` standard normal draws per key, a function of key, seed and place alone."""
    increment = np.uint64(INCREMENT)
    start = mixed(keys.astype(np.uint64) * increment + np.uint64(seed))
    lanes = np.arange(1, 2 * -(-dim // 2) + 1, dtype=np.uint64) * increment
    bits = mixed(start[:, None] + lanes[None, :]) >> np.uint64(11)
    radius = np.sqrt(-2.0 * np.log((bits[:, 0::2].astype(np.float64) + 1.0) * 2.0**-53))
    angle = 2.0 * np.pi * bits[:, 1::2].astype(np.float64) * 2.0**-53
    pairs = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2)
    return pairs.reshape(len(keys), -1)[:, :dim]


def task_vectors(at: int, dim: int, seed: int):
    """The function a task runs: batches in, the same with a unit vector per key appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            units = unit_rows(normal_rows(keys, dim, seed)).astype(np.float32)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * dim)
            vectors = pa.ListArray.from_arrays(ends, pa.array(units.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, vectors], names=[*batch.schema.names, "embedding"]
            )

    return run
