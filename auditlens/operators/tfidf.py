"""TF-IDF on distributed vocabularies.

Terms are counted inside the row or block (no shuffle). Only the document frequencies, the texts and the lookup of a
term's weight move data; the vocabulary never visits the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import run_counts
from ..functions.text import tokens_word
from ..session import cut_lineage
from .termblocks import Block, by_blocks, id_groups, row_groups, text_blocks


@dataclass(frozen=True)
class TfidfModel:
    """``terms``: (term, df, idf); ``documents``: size of the fitted corpus."""

    terms: DataFrame
    documents: int


def term_counts(
    df: DataFrame,
    id: str = "cmd_id",
    text: str = "command",
    tokenizer: Callable[[Column], Column] = tokens_word,
) -> DataFrame:
    """``(id, term, tf)``."""
    counts = run_counts(tokenizer(F.col(text)))
    return df.select(id, F.explode(counts).alias("c")).select(id, "c.term", "c.tf")


def document_frequencies(df: DataFrame, text: str = "command") -> DataFrame:
    """``(term, df)``: number of texts that hold the term, combined before the shuffle."""
    terms = df.select(F.explode(F.array_distinct(tokens_word(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_fit(df: DataFrame, text: str = "command") -> TfidfModel:
    """Smoothed inverse document frequency, ln((1 + n) / (1 + df)) + 1.

    The term table is stored once, so that using the model does not read the corpus again.
    """
    n = df.count()
    idf = F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1
    return TfidfModel(cut_lineage(document_frequencies(df, text).withColumn("idf", idf)), n)


def weighted_terms(
    df: DataFrame, terms: DataFrame, columns: tuple[str, ...], id: str, text: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, term, raw, *columns)`` with raw = tf * idf. Texts stay even without terms;
    unknown terms have nulls. A term's row is unique, so a frequent term makes the left side of
    this join skewed only, which adaptive execution splits. It holds no state, so ``df`` may be a stream."""
    counts = run_counts(tokens_word(F.col(text)))
    long = df.select(id, *keep, F.explode_outer(counts).alias("c")).select(id, *keep, "c.term", "c.tf")
    known = long.join(terms.select("term", "idf", *columns), "term", "left")
    return known.withColumn("raw", F.col("tf") * F.col("idf")).drop("tf", "idf")


def tfidf_vectors(
    df: DataFrame, model: TfidfModel, id: str = "cmd_id", text: str = "command", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, vector)`` with ``vector`` an array of (term, weight), L2-normalised, by term.

    Unknown terms are dropped; a text without known terms has an empty vector. Weights are looked up once per block of
    texts and term, and a block returns whole vectors.
    """
    blocks = text_blocks(df, text)
    if blocks > 1:
        return _vectors_by_blocks(df, model, blocks, id, text, keep)
    weighted = weighted_terms(df, model.terms, (), id, text, keep)
    entry = F.when(F.col("raw").isNotNull(), F.struct("term", F.col("raw").alias("weight")))
    # The norm is an aggregate, not a second walk over the finished array.
    rows = weighted.groupBy(id, *keep).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
    )
    unit = F.transform(
        "entries",
        lambda e: F.struct(e["term"].alias("term"), (e["weight"] / F.col("norm")).alias("weight")),
    )
    return rows.select(id, *keep, unit.alias("vector"))


def _vectors_by_blocks(
    df: DataFrame, model: TfidfModel, blocks: int, id: str, text: str, keep: tuple[str, ...]
) -> DataFrame:
    entry = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    schema = T.StructType([df.schema[c] for c in (id, *keep)]).add("vector", T.ArrayType(entry))

    def weigh(block: Block) -> pa.Table:
        raw = block.times * block.values[block.codes, 0]
        known = np.flatnonzero(~np.isnan(raw))
        first, group = row_groups(block.kept)
        owner, code, raw = group[block.row[known]], block.codes[known], raw[known]
        rank = np.empty(len(block.terms), np.int64)
        rank[pc.sort_indices(block.terms).to_numpy()] = np.arange(len(rank))
        order = np.lexsort((raw, rank[code], owner))
        norm = np.sqrt(np.bincount(owner, raw * raw, minlength=len(first)))
        weight = (raw / norm[owner])[order]
        entries = pa.StructArray.from_arrays([block.terms.take(pa.array(code[order])), pa.array(weight)], ["term", "weight"])
        edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(first))))).astype(np.int32)
        columns = [c.take(pa.array(first)) for c in block.kept]
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(edges), entries)], names=schema.names)

    return by_blocks(df, blocks, model.terms, "term", ("idf",), (id, *keep), tokens_word, text, weigh, schema)


def tfidf_transform(
    df: DataFrame, model: TfidfModel, id: str = "cmd_id", text: str = "command", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, term, weight)``, L2-normalised per text; a text without known terms has no rows.

    Weights are looked up once per block of texts and term, and a block returns its rows normalised.
    """
    blocks = text_blocks(df, text)
    if blocks == 1:
        raw = F.col("raw")
        norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(id)))
        weighted = weighted_terms(df, model.terms, (), id, text, keep).where("raw is not null")
        return weighted.select(id, *keep, "term", (raw / norm).alias("weight"))
    names = [id, *keep, "term", "weight"]
    schema = T.StructType([*(df.schema[c] for c in (id, *keep)), T.StructField("term", T.StringType())])
    schema = schema.add("weight", T.DoubleType())

    def weigh(block: Block) -> pa.Table:
        raw = block.times * block.values[block.codes, 0]
        known = np.flatnonzero(~np.isnan(raw))
        row, raw = block.row[known], raw[known]
        group = id_groups(block.kept[0])
        norm = np.sqrt(np.bincount(group[row], raw * raw, minlength=len(block.lengths)))
        columns = [c.take(pa.array(row)) for c in block.kept]
        terms = block.terms.take(pa.array(block.codes[known]))
        return pa.Table.from_arrays([*columns, terms, pa.array(raw / norm[group[row]])], names=names)

    return by_blocks(df, blocks, model.terms, "term", ("idf",), (id, *keep), tokens_word, text, weigh, schema)


def term_scores(
    df: DataFrame,
    terms: DataFrame,
    columns: tuple[str, ...],
    id: str = "cmd_id",
    text: str = "command",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *keep, norm, *columns)``: dot product of each text's unit TF-IDF vector with some
    per-term columns of ``terms`` (term, idf, *columns).

    The vectors themselves are never built: a block of texts returns a row of sums per text. ``norm`` is 0, and
    so are the products, for a text without known terms.
    """
    blocks = text_blocks(df, text)
    if blocks == 1:
        return summed_terms(weighted_terms(df, terms, columns, id, text, keep), columns, id, keep)
    sums = ["_squares", *(f"_dot{i}" for i in range(len(columns)))]
    schema = T.StructType([df.schema[c] for c in (id, *keep)])
    for name in sums:
        schema = schema.add(name, T.DoubleType())

    def score(block: Block) -> pa.Table:
        texts = len(block.lengths)
        values = np.nan_to_num(block.values[block.codes])
        raw = block.times * values[:, 0]
        found = [np.bincount(block.row, raw * x, minlength=texts).astype(float) for x in (raw, *values.T[1:])]
        return pa.Table.from_arrays([*block.kept, *map(pa.array, found)], names=[id, *keep, *sums])

    scored = by_blocks(df, blocks, terms, "term", ("idf", *columns), (id, *keep), tokens_word, text, score, schema)
    norm = F.sqrt(F.sum("_squares"))
    return scored.groupBy(id, *keep).agg(
        norm.alias("norm"),
        *[F.coalesce(F.try_divide(F.sum(f"_dot{i}"), norm), F.lit(0.0)).alias(c) for i, c in enumerate(columns)],
    )


def summed_terms(known: DataFrame, columns: tuple[str, ...], id: str = "cmd_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """What :func:`term_scores` gives, from rows of :func:`weighted_terms`."""
    raw = F.col("raw")
    norm = F.sqrt(F.coalesce(F.sum(raw * raw), F.lit(0.0)))
    return known.groupBy(id, *keep).agg(
        norm.alias("norm"),
        *[F.coalesce(F.try_divide(F.sum(raw * F.col(c)), norm), F.lit(0.0)).alias(c) for c in columns],
    )
