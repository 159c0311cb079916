"""Scanners for :func:`auditlens.operators.blockjoin.block_join`: numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Queries and cells (reference rows x queries) of one tile, which fits the caches of a core.
QUERIES = 2048
CELLS = 1 << 19
# A term held by so large a share of the queries, times its share of the references, is cheaper as a column of a dense
# matrix than as postings; bytes of that matrix for a block of queries.
DENSE_SHARE = 1 / 256
DENSE_BYTES = 64 << 20


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Flat values and the row each belongs to."""
    column = _one(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), lengths)


def _dictionary(terms: pa.Array) -> pa.DictionaryArray:
    return terms if pa.types.is_dictionary(terms.type) else terms.dictionary_encode()


def _table(row: np.ndarray, column: np.ndarray, weights: np.ndarray | None, shape: tuple[int, int], kind: type) -> np.ndarray:
    """A matrix of summed entries."""
    return np.bincount(row * shape[1] + column, weights, minlength=shape[0] * shape[1]).reshape(shape).astype(kind)


def _cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the set cells, which are few."""
    return np.divmod(np.flatnonzero(mask.reshape(-1)), max(1, mask.shape[1]))


class _Postings:
    """Sums over shared terms for all pairs of a block of queries and a batch of references, tile by tile.

    The queries of a tile have an inverted index: for each term those that hold it. Terms that many rows of both
    sides hold are columns of a dense matrix instead, which is multiplied as such. Counts are exact as ``float32``,
    weights are ``float64``.
    """

    def __init__(self, terms: pa.Array, owner: np.ndarray, n: int, weights: np.ndarray | None = None):
        encoded = _dictionary(terms)
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.n, self.kind = n, np.float32 if weights is None else np.float64
        self.vocabulary = encoded.dictionary
        size = len(self.vocabulary)
        held = np.bincount(codes, minlength=size)
        often = np.flatnonzero(held > DENSE_SHARE * n)
        most = DENSE_BYTES // (np.dtype(self.kind).itemsize * max(1, n))
        self.often = often[np.argsort(-held[often], kind="stable")[:most]]
        self.share = held[self.often] / max(1, n)
        column = np.full(size, -1)
        column[self.often] = np.arange(len(self.often))
        at = column[codes]
        dense = at >= 0
        own = None if weights is None else weights[dense]
        self.matrix = _table(at[dense], owner[dense], own, (len(self.often), n), self.kind)
        self.tiles = []
        for first in range(0, n, QUERIES):
            last = min(n, first + QUERIES)
            part = slice(*np.searchsorted(owner, [first, last]))
            order = np.argsort(codes[part], kind="stable")
            length = np.bincount(codes[part], minlength=size).astype(np.int32)
            start = (np.cumsum(length) - length).astype(np.int32)
            own = None if weights is None else weights[part][order]
            self.tiles.append((first, last, owner[part][order] - first, own, length, start))

    def products(
        self, terms: pa.Array, row: np.ndarray, rows: int, weights: np.ndarray | None = None
    ) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """``(rows, queries, matrix)`` of shared-term sums."""
        encoded = _dictionary(terms)
        place = pc.fill_null(pc.index_in(encoded.dictionary, value_set=self.vocabulary), -1)
        codes = place.to_numpy(zero_copy_only=False)[encoded.indices.to_numpy(zero_copy_only=False)]

        def only(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
            return codes[kept], row[kept], None if weights is None else weights[kept]

        codes, row, weights = only(codes >= 0)
        shared = self.share * np.bincount(codes, minlength=len(self.vocabulary))[self.often]
        used = np.flatnonzero(shared > DENSE_SHARE * rows)
        column = np.full(len(self.vocabulary), -1)
        column[self.often[used]] = np.arange(len(used))
        at = column[codes]
        _, dense_row, own = only(at >= 0)
        left = _table(dense_row, at[at >= 0], own, (rows, len(used)), self.kind)
        right = self.matrix if len(used) == len(self.often) else self.matrix[used]
        codes, row, weights = only(at < 0)
        for first_query, last_query, owner, own, length, start in self.tiles:
            width = last_query - first_query
            met = np.flatnonzero(length[codes])
            mine, its_row = codes[met], row[met]
            fan_out = length[mine].astype(np.int64)
            begin = start[mine].astype(np.int64)
            value = None if weights is None else weights[met]
            load = np.concatenate(([0], np.cumsum(np.bincount(its_row, weights=fan_out, minlength=rows))))
            edge = np.concatenate(([0], np.cumsum(np.bincount(its_row, minlength=rows))))
            step = max(1, CELLS // width)
            first = 0
            while first < rows:
                last = min(rows, first + step)
                last = max(first + 1, min(last, int(np.searchsorted(load, load[first] + 2 * CELLS, "right")) - 1))
                tile = left[first:last] @ right[:, first_query:last_query]
                part = slice(edge[first], edge[last])
                if part.start < part.stop:
                    copies = fan_out[part]
                    ends = np.cumsum(copies)
                    at = np.repeat(begin[part] - (ends - copies), copies) + np.arange(ends[-1])
                    cell = np.repeat((its_row[part] - first) * width, copies)
                    cell += owner[at]
                    if value is None:
                        shares = np.ones(len(cell), self.kind)
                    else:
                        shares = np.repeat(value[part], copies)
                        shares *= own[at]
                    np.add.at(tile.reshape(-1), cell, shares)
                yield slice(first, last), slice(first_query, last_query), tile
                first = last


class NearestOverlap:
    """Smallest set-overlap distance per query.

    Rows are (id, tokens: distinct tokens, size: list size). The result is the exact fraction
    numerator / denominator, of equal fractions the one with the smallest numbers; the denominator
    is 1 for the un-normalised distance.
    """

    SCHEMA = "id long, numerator long, denominator long"

    def __init__(self, queries: pa.Table, normalised: bool = True):
        self.ids = _one(queries["id"])
        self.size = _one(queries["size"]).to_numpy(zero_copy_only=False).astype(np.int64)
        self.normalised = normalised
        self.postings = _Postings(*_lists(queries["tokens"]), len(self.ids))
        self.best = np.full(len(self.ids), np.inf)
        self.numerator = np.zeros(len(self.ids), dtype=np.int64)
        self.denominator = np.ones(len(self.ids), dtype=np.int64)
        self.total = np.zeros(len(self.ids), dtype=np.int64)

    def feed(self, batch: pa.RecordBatch) -> None:
        # A list without tokens has no distance.
        batch = batch.filter(pc.greater(batch.column("size"), 0))
        if not len(self.ids) or not batch.num_rows:
            return
        # Short lists come first, so that of equal distances argmax finds that of the smallest total.
        batch = batch.take(pc.array_sort_indices(batch.column("size")))
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        terms, row = _lists(batch.column("tokens"))
        # Whole numbers below 2^24 and their rounded quotients keep their order as float32.
        kind = np.float32 if size[-1] + self.size.max() < 1 << 24 else np.float64
        sizes, own = size.astype(kind), self.size.astype(kind)
        for rows, queries, shared in self.postings.products(terms, row, batch.num_rows):
            score = sizes[rows, None] + own[None, queries]
            # 1 - 2 x overlap / total is smallest where overlap / total is largest.
            score = np.divide(shared, score, out=score) if self.normalised else np.subtract(2 * shared, score, out=score)
            top = score.max(axis=0)
            self._improve(top, score, shared, size[rows], queries)

    def _improve(self, top: np.ndarray, score: np.ndarray, shared: np.ndarray, size: np.ndarray, queries: slice) -> None:
        """Take over the exact best of the references whose rounded ``score`` is a query's ``top``."""
        best, total = self.best[queries], self.total[queries]
        open_ = np.flatnonzero((top >= (-best).astype(score.dtype)) & (self.size[queries] > 0))
        if not len(open_):
            return
        at = score[:, open_]
        first = at.argmax(axis=0)
        nothing = (top[open_] == 0) if self.normalised else np.zeros(len(open_), bool)
        row, query = _cells((at == top[open_]) & ~nothing)
        row = np.concatenate((row, first[nothing]))
        query = open_[np.concatenate((query, np.flatnonzero(nothing)))]
        totals = size[row] + self.size[queries][query]
        overlap = np.rint(shared[row, query]).astype(np.int64)
        rank = -overlap / totals if self.normalised else (totals - 2 * overlap).astype(float)
        order = np.lexsort((totals, rank, query))
        order = order[np.flatnonzero(np.diff(query[order], prepend=-1))]
        row, query, totals, overlap, rank = (x[order] for x in (row, query, totals, overlap, rank))
        better = (rank < best[query]) | ((rank == best[query]) & (totals < total[query]))
        query, totals, overlap = query[better], totals[better], overlap[better]
        best[query], total[query] = rank[better], totals
        self.numerator[queries][query] = totals - 2 * overlap
        if self.normalised:
            self.denominator[queries][query] = totals

    def finish(self) -> pa.Table:
        found = np.isfinite(self.best)
        return pa.table(
            {
                "id": self.ids.filter(pa.array(found)).cast(pa.int64()),
                "numerator": self.numerator[found],
                "denominator": self.denominator[found],
            }
        )


class _Vectors:
    """Euclidean distances from a block of query vectors to batches of reference vectors."""

    def __init__(self, queries: pa.Table):
        self.ids = _one(queries["id"]).to_numpy(zero_copy_only=False)

    def squared(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
        """``(rows, queries, squared distances, largest squared norm)``."""
        raise NotImplementedError

    def near(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
        """``(rows, queries, squared distances, how much these may be off)``, before the :meth:`exact` ones."""
        for rows, queries, squared, largest in self.squared(batch):
            yield rows, queries, squared, 1e-12 * largest

    def exact(self, batch: pa.RecordBatch, row: np.ndarray, query: np.ndarray, squared: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squared, 0.0))


class _Sparse(_Vectors):
    """Columns (id, terms, weights)."""

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        terms, owner = _lists(queries["terms"])
        weights = _one(queries["weights"]).flatten().to_numpy(zero_copy_only=False)
        # An empty bincount has whole numbers, whatever its weights.
        self.norms = np.bincount(owner, weights=weights**2, minlength=len(self.ids)).astype(float)
        self.postings = _Postings(terms, owner, len(self.ids), weights)

    def squared(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
        terms, row = _lists(batch.column("terms"))
        weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False)
        norms = np.bincount(row, weights=weights**2, minlength=batch.num_rows).astype(float)
        largest = max(norms.max(), self.norms.max())
        for rows, queries, found in self.postings.products(terms, row, batch.num_rows, weights):
            found *= -2
            found += norms[rows, None]
            found += self.norms[None, queries]
            yield rows, queries, found, largest


class _Dense(_Vectors):
    """Columns (id, features) of equal length."""

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        flat = _one(queries["features"]).flatten().to_numpy(zero_copy_only=False)
        self.points = flat.astype(np.float64).reshape(len(self.ids), -1)
        self.single: np.ndarray | None = None

    def _rows(self, batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(batch.num_rows, -1)

    def squared(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
        points = self._rows(batch)
        norms, own = (points**2).sum(axis=1), (self.points**2).sum(axis=1)
        largest = max(norms.max(), own.max())
        for rows, queries in self._tiles(len(points)):
            dots = points[rows] @ self.points[queries].T
            yield rows, queries, norms[rows, None] + own[None, queries] - 2 * dots, largest

    def near(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
        points = self._rows(batch)
        norms, own = (points**2).sum(axis=1), (self.points**2).sum(axis=1)
        largest = max(norms.max(), own.max())
        if not 1e-30 < largest < 1e30:
            yield from super().near(batch)
            return
        # One product of (-2x, |x|^2, 1) and (y, 1, |y|^2) in single precision.
        left = np.column_stack((-2 * points, norms, np.ones(len(points)))).astype(np.float32)
        if self.single is None:
            self.single = np.column_stack((self.points, np.ones(len(own)), own)).astype(np.float32).T.copy()
        off = 8 * left.shape[1] * float(np.finfo(np.float32).eps) * largest
        for rows, queries in self._tiles(len(points)):
            yield rows, queries, left[rows] @ self.single[:, queries], off

    def _tiles(self, rows: int) -> Iterator[tuple[slice, slice]]:
        for first in range(0, len(self.ids), QUERIES):
            last = min(len(self.ids), first + QUERIES)
            step = max(1, CELLS // (last - first))
            for at in range(0, rows, step):
                yield slice(at, min(rows, at + step)), slice(first, last)

    def exact(self, batch: pa.RecordBatch, row: np.ndarray, query: np.ndarray, squared: np.ndarray) -> np.ndarray:
        points, found = self._rows(batch), np.empty(len(row))
        step = max(1, CELLS // max(1, points.shape[1]))
        for first in range(0, len(row), step):
            part = slice(first, first + step)
            found[part] = np.sqrt(((points[row[part]] - self.points[query[part]]) ** 2).sum(axis=1))
        return found


def vectors_of(queries: pa.Table, sparse: bool) -> _Vectors:
    return (_Sparse if sparse else _Dense)(queries)


class KNearest:
    """The k nearest references per query, ties by reference id.

    Distances are compared after rounding to ``digits``, so equal rows tie although their
    arithmetic may differ in the last bit. Result: (id, neighbour, distance, label).
    """

    SCHEMA = "id long, neighbour long, distance double, label int"

    def __init__(self, queries: pa.Table, k: int, sparse: bool, digits: int, skip_self: bool):
        self.vectors = vectors_of(queries, sparse)
        self.k, self.digits, self.skip_self = k, digits, skip_self
        self.limit = np.full(len(self.vectors.ids), np.inf)
        # By the first query of a tile: (query, neighbour, distance, label) that are kept, new ones, how many are new.
        self.tiles: dict[int, list] = {}

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) with equal ids."""
        order = np.argsort(self.vectors.ids, kind="stable")
        held = self.vectors.ids[order]
        first, last = (np.searchsorted(held, ids, side) for side in ("left", "right"))
        times = np.where(ids == ids, last - first, 0)
        row = np.repeat(np.arange(len(ids)), times)
        return row, order[np.arange(len(row)) - np.repeat(np.cumsum(times) - times - first, times)]

    def feed(self, batch: pa.RecordBatch) -> None:
        if not len(self.vectors.ids) or not batch.num_rows:
            return
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        labels = pc.fill_null(batch.column("label"), -1).to_numpy(zero_copy_only=False)
        if self.skip_self:
            own_row, own_query = self._own(ids)
        for rows, queries, squared, off in self.vectors.near(batch):
            if self.skip_self:
                here = (own_row >= rows.start) & (own_row < rows.stop) & (own_query >= queries.start) & (own_query < queries.stop)
                squared[own_row[here] - rows.start, own_query[here] - queries.start] = np.inf
            limit = self.limit[queries]
            if len(squared) > self.k and not np.isfinite(limit).all():
                kth = np.partition(squared, self.k - 1, axis=0)[self.k - 1]
                limit = np.minimum(limit, np.sqrt(np.maximum(kth + off, 0.0)))
                self.limit[queries] = limit
            # Whatever could round to the k-th distance stays a candidate.
            reach = (limit + 2 * 10.0**-self.digits) ** 2 + off
            row, query = _cells(squared <= reach.astype(squared.dtype)[None, :])
            found = squared[row, query]
            finite = np.isfinite(found)
            row, query, found = row[finite] + rows.start, query[finite] + queries.start, found[finite]
            exact = self.vectors.exact(batch, row, query, found)
            kept, new, waiting = self.tiles.setdefault(queries.start, [None, [], 0])
            new.append([query, ids[row], exact, labels[row]])
            self.tiles[queries.start][2] = waiting = waiting + len(row)
            # Sorting pays only once the new candidates rival what is kept.
            if waiting > max(0 if kept is None else len(kept[0]), 20_000):
                self._prune(queries.start)

    def _prune(self, tile: int) -> None:
        kept, new, _ = self.tiles[tile]
        columns = [np.concatenate(c) for c in zip(*([] if kept is None else [kept]), *new, strict=True)]
        query, neighbour, distance, _ = columns
        order = np.lexsort((neighbour, np.round(distance, self.digits), query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, last = order[rank < self.k], query[rank == self.k - 1]
        kth = distance[order[rank[rank < self.k] == self.k - 1]]
        self.limit[last] = np.minimum(self.limit[last], kth)
        self.tiles[tile] = [[column[order] for column in columns], [], 0]

    def finish(self) -> pa.Table:
        for tile in self.tiles:
            self._prune(tile)
        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)]
        kept = [part for part, _, _ in self.tiles.values()]
        query, neighbour, distance, label = (np.concatenate(c) for c in zip(empty, *kept, strict=True))
        return pa.table(
            {
                "id": pa.array(self.vectors.ids[query], pa.int64()),
                "neighbour": pa.array(neighbour, pa.int64()),
                "distance": distance,
                "label": pa.array(label, pa.int32()),
            }
        )


class RadiusCounts:
    """Neighbours within a radius per query and label: (id, label, n). A reference row stands for ``n``
    equal ones."""

    SCHEMA = "id long, label int, n long"

    def __init__(self, queries: pa.Table, radius: float, sparse: bool, digits: int):
        self.vectors = vectors_of(queries, sparse)
        self.radius, self.digits = radius, digits
        self.counts: dict[int, np.ndarray] = {}

    def feed(self, batch: pa.RecordBatch) -> None:
        if not len(self.vectors.ids) or not batch.num_rows:
            return
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        weight = batch.column("n").to_numpy(zero_copy_only=False)
        for rows, queries, squared, _ in self.vectors.squared(batch):
            inside = np.round(np.sqrt(np.maximum(squared, 0.0)), self.digits) <= self.radius
            for label in np.unique(labels[rows]):
                own = labels[rows] == label
                hits = (inside[own] * weight[rows][own, None]).sum(axis=0)
                counts = self.counts.setdefault(int(label), np.zeros(len(self.vectors.ids), np.int64))
                counts[queries] += hits

    def finish(self) -> pa.Table:
        tables = [
            pa.table(
                {
                    "id": pa.array(self.vectors.ids, pa.int64()),
                    "label": pa.array(np.full(len(self.vectors.ids), label), pa.int32()),
                    "n": pa.array(hits, pa.int64()),
                }
            )
            for label, hits in sorted(self.counts.items())
        ]
        empty = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("n", pa.int64())]).empty_table()
        return pa.concat_tables([empty, *tables])
