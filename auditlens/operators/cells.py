"""Nearest-reference search between two large sides, comparing only what can matter.

Both sides are put into cells: of the nearest of some pivot rows for Euclidean distances, of similar list
size for overlap distances. A cell has a lower bound on its distance to a query, by the triangle
inequality or by the list sizes. A first pass over one piece of a query's own cell gives a distance the
answer cannot exceed; after it a query goes only to cells whose lower bound does not exceed that.

Cells are put together, or cut by the hash of the row id, into pieces of bounded size, queries into blocks of
bounded size, and only the (block, piece) pairs some query asks for are compared. The result is exact; at worst nothing
can be skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blockjoin import ROW_BYTES, Scanner, pack, unpack
from .linear import list_column
from .sampling import sample_n
from .scanners import vectors_of

CELLS = 64

# Neighbouring list-size cells differ by this factor.
SIZE_STEP = 1.25

# References are dealt to pieces that make about so many pairs with the blocks of queries at least, unless the pieces
# get smaller than an eighth of a block.
PAIRS = 32

# Vectors larger than this are dealt to larger blocks and pieces, up to four times as large, since each is copied once per
# block of the other side.
GROWS_FROM = 512 << 20

KEYS = ["_block", "_piece"]


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def _pieces(df: DataFrame, size: Column, piece_bytes: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """Per cell the number of its first piece, and of how many pieces its rows are dealt to; 0 for an empty cell.

    A cell larger than a piece is cut; neighbouring small cells share one. So there are no more than about two
    pieces for every ``piece_bytes(all bytes)`` of rows, however many cells are filled.
    """
    held = [0] * CELLS
    for row in df.groupBy("_cell").agg(F.sum(size + ROW_BYTES).alias("bytes")).collect():
        held[row["_cell"]] = row["bytes"]
    most = piece_bytes(sum(held))
    first, pieces, last, filled = [0] * CELLS, [0] * CELLS, -1, most
    for cell, there in enumerate(held):
        if not there:
            continue
        pieces[cell] = -(-there // most)
        if pieces[cell] == 1 and filled + there <= most:
            filled += there
        else:
            filled = there if pieces[cell] == 1 else most
            last += 1
        first[cell] = last
        last += pieces[cell] - 1
    return first, pieces


def _grown(block_bytes: int, total: int) -> int:
    return max(block_bytes, min(4 * block_bytes, block_bytes * total // GROWS_FROM))


def _compare_cells(
    queries: DataFrame,
    references: DataFrame,
    columns: list[str],
    scanner: Callable[[pa.Table], Scanner],
    schema: str,
    size: Column,
    block_bytes: int,
    bound: Callable[[DataFrame], DataFrame] | None,
    lower: Callable[[Column], Column],
    within: Callable[[Column], Column],
    grown: Callable[[int, int], int] = lambda block_bytes, total: block_bytes,
) -> DataFrame:
    """Partial results of the scanner.

    Both frames have ``_cell``. ``bound`` turns first-pass partials into (id, _bound) and ``within``
    turns that bound into the distance to search within; ``lower`` is a cell's lower bound.

    Queries go to blocks and references to pieces, both of whole cells or parts of one, and a block meets a piece
    if one of its queries needs one of the piece's cells. What is copied is at most every reference once per
    block and every query once per piece.
    """
    blocks = _pieces(queries, size, lambda total: grown(block_bytes, total))
    # Smaller pieces while there are few pairs, so that there are enough tasks; every piece costs a copy of the queries.
    filled_blocks = max(1, max(blocks[0]) + 1)
    pieces = _pieces(
        references,
        size,
        lambda total: max(block_bytes // 8, min(grown(block_bytes, total), total * filled_blocks // PAIRS), 1),
    )

    def dealt(df: DataFrame, at: tuple[list[int], list[int]], name: str) -> DataFrame:
        first, parts = (_pick(values, F.col("_cell")) for values in at)
        return df.withColumn(name, (first + F.pmod(F.xxhash64("id"), parts)).cast("bigint"))

    # Fresh names keep the two sides of the cogroup apart, also when a frame is compared with itself.
    placed = dealt(references.select(*[F.col(c).alias(c) for c in references.columns]), pieces, "_piece")
    asking = dealt(queries, blocks, "_block")
    fewest = F.array(*[F.lit(first) for first in pieces[0]])

    def compare(left: DataFrame) -> DataFrame:
        left = left.select(*columns, *KEYS)
        wanted = left.select(*[F.col(c).alias(f"{c}_of") for c in KEYS]).distinct()
        right = placed.drop("_cell").join(wanted, F.col("_piece") == F.col("_piece_of")).drop("_piece")

        def meet(some: pa.Table, others: pa.Table) -> pa.Table:
            work = scanner(some)
            for batch in others.to_batches(max_chunksize=10_000):
                work.feed(batch)
            return work.finish()

        grouped = right.groupBy(*[f"{c}_of" for c in KEYS])
        return left.groupBy(*KEYS).cogroup(grouped).applyInArrow(meet, schema)

    everything = sum(pieces[1]) == 1 or not any(pieces[1])
    if bound is not None and not everything:
        filled = _pick(pieces[1], F.col("_cell")) > 0
        own = asking.where(filled).withColumn("_piece", F.get(fewest, F.col("_cell")).cast("bigint"))
        asking = asking.join(cut_lineage(bound(compare(own))), "id", "left")
        found = F.coalesce(F.col("_bound"), F.lit(float("inf")))
    else:
        found = F.lit(float("inf"))
    parts = F.array(*[F.lit(n) for n in pieces[1]])
    held = [c for c in range(CELLS) if pieces[1][c]]
    needed = F.filter(F.array(*[F.lit(c) for c in held]).cast("array<int>"), lambda c: lower(c) <= F.col("_within"))
    numbers = F.flatten(
        F.transform(needed, lambda c: F.sequence(F.get(fewest, c), F.get(fewest, c) + F.get(parts, c) - 1))
    )
    targets = asking.withColumn("_within", within(found)).withColumn("_piece", F.explode(F.array_distinct(numbers)))
    targets = targets.withColumn("_piece", F.col("_piece").cast("bigint"))
    return compare(targets)


def collapse(df: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row (id, *payload) per distinct payload, and the (id, rep) of every row.

    Equal queries have equal answers, so only one of them searches. Copies are counted away before
    the shuffle, and the representatives are unique per payload and stored, so a payload shared by
    much of the data makes only the long side of the join skewed, which adaptive execution splits.
    Store what is joined to the copies, too.
    """
    unique = cut_lineage(df.groupBy(*payload).agg(F.min("id").alias("rep")))
    copies = df.join(unique, payload).select("id", "rep")
    return unique.select(F.col("rep").alias("id"), *payload), copies


def _to_pivots(df: DataFrame, pivots: pa.Table, sparse: bool) -> DataFrame:
    """Add ``_far``: distances to all pivots, ``_cell``: the nearest one, ``_reach``: its distance."""
    shared = df.sparkSession.sparkContext.broadcast(pack(pivots))
    names = df.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = vectors_of(unpack(shared.value), sparse)
        for batch in batches:
            far = np.zeros((batch.num_rows, len(vectors.ids)))
            if batch.num_rows:
                for rows, pivot, squared, _ in vectors.squared(batch):
                    far[rows, pivot] = np.sqrt(np.maximum(squared, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(far)], names=[*names, "_far"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    measured = df.mapInArrow(measure, ", ".join([*fields, "_far array<double>"]))
    reach = F.array_min("_far")
    return measured.withColumn("_reach", reach).withColumn(
        "_cell", (F.array_position("_far", reach) - 1).cast("int")
    )


def pivot_join(
    queries: DataFrame,
    references: DataFrame,
    scanner: Callable[[pa.Table], Scanner],
    schema: str,
    sparse: bool,
    size: Column,
    block_bytes: int,
    k: int | None = None,
    radius: float = 0.0,
    digits: int = 9,
) -> DataFrame:
    """Euclidean search for the k nearest, or for everything within ``radius``.

    ``size`` is the bytes of a row; distances are compared after rounding to ``digits``.
    """
    columns = list(queries.columns)
    pivots = sample_n(references, CELLS, "id").select(*columns).toArrow()
    near_q = cut_lineage(_to_pivots(queries, pivots, sparse))
    near_r = cut_lineage(_to_pivots(references, pivots, sparse).drop("_far"))
    reach = [float("-inf")] * CELLS
    for row in near_r.groupBy("_cell").agg(F.max("_reach").alias("reach")).collect():
        reach[row["_cell"]] = row["reach"]

    def kth(partials: DataFrame) -> DataFrame:
        found = partials.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("_bound"))
        return found.where(F.col("n") >= k).select("id", "_bound")

    # Room for the rounding of distances, and for cancellation in the distances to the pivots.
    slack = 2 * 10.0**-digits + 1e-6 * (1 + F.array_max("_far"))
    return _compare_cells(
        near_q,
        near_r.drop("_reach"),
        columns,
        scanner,
        schema,
        size,
        block_bytes,
        bound=None if k is None else kth,
        lower=lambda c: F.get("_far", c) - _pick(reach, c),
        within=lambda found: (F.lit(radius) if k is None else found) + slack,
        grown=_grown,
    )


def size_join(
    queries: DataFrame,
    references: DataFrame,
    scanner: Callable[[pa.Table], Scanner],
    schema: str,
    size: Column,
    block_bytes: int,
    normalised: bool,
) -> DataFrame:
    """Overlap search on (id, tokens, size) for the smallest distance.

    With d distinct tokens and list size n a query shares at most min(d, m) tokens with a list of size m,
    so the distance is smallest for the m in a cell that is nearest to d.
    """
    columns = list(queries.columns)
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(SIZE_STEP)))
    cell = F.least(band, F.lit(CELLS - 1)).cast("int").alias("_cell")
    near_q, near_r = (df.select("*", cell) for df in (queries, references))
    smallest, largest = [0] * CELLS, [0] * CELLS
    for row in near_r.groupBy("_cell").agg(F.min("size").alias("low"), F.max("size").alias("high")).collect():
        smallest[row["_cell"]], largest[row["_cell"]] = row["low"], row["high"]

    def smallest_found(partials: DataFrame) -> DataFrame:
        return partials.groupBy("id").agg(F.min(F.col("numerator") / F.col("denominator")).alias("_bound"))

    def lower(c: Column) -> Column:
        distinct, n = F.size("tokens"), F.col("size")
        m = F.least(F.greatest(distinct, _pick(smallest, c)), _pick(largest, c))
        gap = n + m - 2 * F.least(distinct, m)
        return gap / F.greatest(n + m, F.lit(1)) if normalised else gap.cast("double")

    return _compare_cells(
        near_q,
        near_r,
        columns,
        scanner,
        schema,
        size,
        block_bytes,
        bound=smallest_found,
        lower=lower,
        within=lambda found: found + 1e-9,
    )
