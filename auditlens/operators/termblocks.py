"""Lookups of all tokens of all texts in a distributed table, by blocks of texts.

Texts are dealt into blocks by their id. A block numbers its distinct tokens once, asks the table for each of them
once, and gets numbers back. So what is shuffled is one row per block and distinct token, not one row per text and
token; neither the table nor a vocabulary is broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

# Characters of a block of texts, on average.
BLOCK_CHARS = 8 << 20
_OWN = [("lengths", T.IntegerType()), ("codes", T.IntegerType()), ("times", T.IntegerType()), ("terms", T.StringType())]


def _ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(np.int64)


def text_blocks(df: DataFrame, text: str) -> int:
    """Blocks that the texts fill. Texts of one block gain nothing from it; a plain join is quicker there."""
    return 1 + (df.agg(F.sum(F.length(text))).first()[0] or 0) // BLOCK_CHARS


def id_groups(ids: pa.Array) -> np.ndarray:
    """Equal numbers for equal ids, nulls being equal too."""
    return _ints(ids.dictionary_encode(null_encoding="encode").indices)


def row_groups(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every group of rows that are equal in all ``columns``, nulls being equal too, and each row's group."""
    first, group = np.zeros(min(1, len(columns[0])), np.int64), np.zeros(len(columns[0]), np.int64)
    for column in columns:
        numbers = id_groups(column)
        _, first, group = np.unique(group * (1 + numbers.max(initial=0)) + numbers, return_index=True, return_inverse=True)
    return first, group


def _pack(width: int, counted: bool, schema: pa.Schema) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").combine_chunks()
        lengths = _ints(tokens.value_lengths().fill_null(0))
        coded = tokens.flatten().dictionary_encode()
        codes, terms = _ints(coded.indices), coded.dictionary
        times = np.empty(0, np.int64)
        if counted:
            size = max(1, len(terms))
            cells, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + codes, return_counts=True)
            lengths, codes = np.bincount(cells // size, minlength=len(lengths)), cells % size
        columns = [table.column(f"k{i}").combine_chunks() for i in range(width)]
        columns += [pa.array(x.astype(np.int32)) for x in (lengths, codes, times)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in [*columns, terms]]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *lists], names=schema)

    return run


class Block:
    """The texts of a block: ``kept`` columns, ``lengths`` entries each, ``codes`` of their tokens in ``terms``; with
    counted entries a text has every token once and ``times`` how often. ``values`` holds a column per looked-up
    column, NaN where the table lacks the token."""

    def __init__(self, block: pa.Table, known: pa.Table, width: int, values: int) -> None:
        held = [block.column(i + 1).combine_chunks().flatten() for i in range(width + len(_OWN))]
        self.kept, self.terms = held[:width], held[-1]
        self.lengths, self.codes, self.times = (_ints(c) for c in held[width:-1])
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.values = np.full((len(self.terms), values), np.nan)
        at = _ints(known.column("code"))
        for i in range(values):
            self.values[at, i] = known.column(f"v{i}").to_numpy()


def by_blocks(
    df: DataFrame,
    blocks: int,
    table: DataFrame,
    key: str,
    values: tuple[str, ...],
    kept: tuple[str, ...],
    tokens: Callable[[Column], Column],
    text: str,
    answer: Callable[[Block], pa.Table],
    schema: T.StructType,
    counted: bool = True,
) -> DataFrame:
    """What ``answer`` makes of every block, after all its tokens are looked up in ``table``, unique per ``key``.

    ``kept`` are columns of ``df``; rows with equal values of the first lie in one block.
    """
    width = len(kept)
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    # The texts are shuffled, and tokenised where they arrive.
    dealt = df.select(F.pmod(F.xxhash64(kept[0]), F.lit(blocks)).alias("block"), *own, F.col(text).alias("_text"))
    dealt = dealt.repartition("block").withColumn("tokens", tokens(F.col("_text"))).drop("_text")
    fields = [(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + _OWN
    packed = T.StructType([T.StructField("block", T.LongType())])
    for name, kind in fields:
        packed.add(name, T.ArrayType(kind))
    pack = _pack(width, counted, packed.names)
    held = stored(dealt.groupBy("block").applyInArrow(pack, packed), "blocks")
    looked_up = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)]
    known = (
        held.select(F.col("block").alias("of"), F.posexplode("terms").alias("code", "_term"))
        .join(table.select(F.col(key).alias("_term"), *looked_up), "_term")
        .drop("_term")
    )

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        return answer(Block(block, found, width, len(values)))

    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, schema)
