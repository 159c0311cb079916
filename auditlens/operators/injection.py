"""Injection set: normal commands with an abnormal one appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ABNORMAL, INJECTION_TOKENS
from ..functions.common import hash_uint32
from .sampling import hash_position


def inject(
    normals: DataFrame,
    abnormals: DataFrame,
    tokens: Sequence[str] = INJECTION_TOKENS,
    n: int = 100,
    seed: int = 0,
    key: str = "command",
) -> DataFrame:
    """``(normal_no, abnormal_no, command, label)``: n sampled normals with each of n sampled
    abnormals, glued by a token the pair's hash picks. The label is always abnormal.

    The abnormal sample is joined by its position, so the size is n x n whatever the inputs hold.
    """
    left = hash_position(normals, key, f"{seed}-normal", upto=n, position="normal_no").select(
        "normal_no", F.col("command").alias("head")
    )
    right = hash_position(abnormals, key, f"{seed}-abnormal", upto=n, position="abnormal_no").select(
        "abnormal_no", F.col("command").alias("tail")
    )
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")))
    pairs = left.withColumn("abnormal_no", numbers).join(right, "abnormal_no")
    pick = hash_uint32(F.concat_ws("|", "normal_no", "abnormal_no"), seed) % len(tokens)
    token = F.get(F.array(*[F.lit(t) for t in tokens]), pick.cast("int"))
    return pairs.select(
        "normal_no",
        "abnormal_no",
        F.concat("head", token, "tail").alias("command"),
        F.lit(ABNORMAL).alias("label"),
    )
