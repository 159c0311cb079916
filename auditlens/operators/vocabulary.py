"""Token vocabularies, encoding and padded batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens_ws
from ..session import cut_lineage
from .sampling import hash_position
from .termblocks import Block, by_blocks, id_groups, text_blocks


def build_vocabulary(
    df: DataFrame,
    tokenizer: Callable[[Column], Column] = tokens_ws,
    base: DataFrame | None = None,
    text: str = "command",
) -> DataFrame:
    """``(token, token_id)`` with ids from 1.

    With ``base`` the old ids are kept and new tokens continue after the largest one. New tokens
    are numbered in hash order, which needs no global sort; ids are only compared for equality.
    The distinct tokens are stored once, so the corpus is read once.
    """
    tokens = df.select(F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("token")).distinct()
    if base is None:
        return hash_position(cut_lineage(tokens), "token", position="token_id")
    start = base.agg(F.coalesce(F.max("token_id"), F.lit(0))).first()[0]
    fresh = cut_lineage(tokens.join(base, "token", "left_anti"))
    fresh = hash_position(fresh, "token", position="token_id")
    return base.select("token", "token_id").unionByName(
        fresh.select("token", (F.col("token_id") + start).alias("token_id"))
    )


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    tokenizer: Callable[[Column], Column],
    id: str = "cmd_id",
    text: str = "command",
    ids: str = "ids",
) -> DataFrame:
    """``(id, ids)``: token ids in text order, -1 for unknown tokens, empty text gives [].

    Tokens are looked up once per block of texts; rows of one id are one text, by place and token id.
    """
    blocks = text_blocks(df, text)
    if blocks == 1:
        return gathered_ids(token_rows(df, vocabulary, tokenizer, id, text), id, ids)
    kind = vocabulary.schema["token_id"].dataType
    schema = T.StructType([df.schema[id], T.StructField(ids, T.ArrayType(kind))])

    def answer(block: Block) -> pa.Table:
        found = block.values[block.codes, 0]
        found = np.where(np.isnan(found), -1, found).astype(np.int64)
        lengths, key = block.lengths, block.kept[0]
        group = id_groups(key)
        texts, first = np.unique(group, return_index=True)
        if len(texts) < len(group):
            place = np.arange(len(found)) - (np.cumsum(lengths) - lengths)[block.row]
            found = found[np.lexsort((found, place, group[block.row]))]
            lengths, key = np.bincount(group, lengths).astype(np.int64), key.take(pa.array(first))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        numbers = pa.array(found).cast(pa.int64() if kind == T.LongType() else pa.int32())
        return pa.Table.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets), numbers)], names=[id, ids])

    columns = ("token_id",)
    return by_blocks(df, blocks, vocabulary, "token", columns, (id,), tokenizer, text, answer, schema, counted=False)


def token_rows(
    df: DataFrame,
    vocabulary: DataFrame,
    tokenizer: Callable[[Column], Column],
    id: str = "cmd_id",
    text: str = "command",
) -> DataFrame:
    """``(id, pos, token_id)`` of every token, -1 if unknown; one row with null ``pos`` for a text without
    tokens. It holds no state, so ``df`` may be a stream."""
    occurrences = df.select(id, F.posexplode_outer(tokenizer(F.col(text))).alias("pos", "token"))
    looked_up = occurrences.join(vocabulary.select("token", "token_id"), "token", "left")
    return looked_up.select(id, "pos", F.coalesce("token_id", F.lit(-1)).alias("token_id"))


def gathered_ids(rows: DataFrame, id: str = "cmd_id", ids: str = "ids") -> DataFrame:
    """``(id, ids)`` of rows of :func:`token_rows`, in text order."""
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))
    return (
        rows.groupBy(id)
        .agg(F.sort_array(F.collect_list(entry)).alias("placed"))
        .select(id, F.col("placed.token_id").alias(ids))
    )


def padded_batches(
    df: DataFrame, size: int = 128, key: str = "cmd_id", ids: str = "ids", seed: int = 0
) -> DataFrame:
    """Batches of ``size`` rows in shuffled order, ids padded with 0 to the longest of the batch.

    Adds ``batch_id`` and ``position``; a batch is a bounded group.
    """
    ranked = hash_position(df, key, seed).withColumn(
        "batch_id", F.floor((F.col("position") - 1) / size).cast("bigint")
    )
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    padding = F.array_repeat(F.lit(0).cast("bigint"), longest - F.size(ids))
    return ranked.withColumn(ids, F.concat(F.col(ids), padding))
