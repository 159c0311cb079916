"""Padded id sequences for a neural model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokens_alnum
from ..operators.sampling import hash_position
from ..operators.vocabulary import build_vocabulary, encode, padded_batches
from ..session import cut_lineage


def prepare_sequences(
    df: DataFrame, take: int = 3000, size: int = 128, id: str = "cmd_id", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Test batches (the first ``take`` rows in shuffled order) and train batches (the others).

    Commands are trimmed, tokenised, encoded with ids from 1, and padded with 0 per batch.
    """
    trimmed = df.select(id, "label", strip(F.col("command")).alias("command"))
    vocabulary = build_vocabulary(trimmed, tokens_alnum)
    ids = encode(trimmed, vocabulary, tokens_alnum, id)
    # Numbering and batching read the encoded rows several times.
    encoded = cut_lineage(trimmed.select(id, "label").join(ids, id))
    ranked = hash_position(encoded, id, seed, position="rank")
    test = ranked.where(F.col("rank") <= take).drop("rank")
    train = ranked.where(F.col("rank") > take).drop("rank")
    return padded_batches(test, size, id, "ids", seed), padded_batches(train, size, id, "ids", f"{seed}-train")
