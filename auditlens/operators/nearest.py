"""Nearest token-set distance and the detector built on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ABNORMAL, DETECTOR_SEEDS, NORMAL, WHITESPACE_CLASS
from ..functions.common import bind
from ..functions.text import strip, tokens_strict, tokens_ws
from ..session import cut_lineage
from .blockjoin import BLOCK_BYTES, block_join
from .evaluation import sweep_fraction
from .sampling import hash_position, sample_n
from .scanners import NearestOverlap
from .setjoin import nearest_sets
from .sets import set_minus

# Stands for every token without a vocabulary id; such tokens all compare equal.
UNKNOWN = "\u0000unknown"


def _sides(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """``(id, tokens: distinct tokens, size: list size)``; the token expression runs once per row."""
    both = bind(tokens, lambda t: F.struct(F.array_distinct(t).alias("tokens"), F.size(t).alias("size")))
    return df.select(F.col(id).cast("bigint").alias("id"), both.alias("s")).select("id", "s.tokens", "s.size")


def _smallest(partials: DataFrame) -> DataFrame:
    value = F.col("numerator") / F.col("denominator")
    best = F.min(F.struct(value.alias("distance"), "numerator", "denominator")).alias("best")
    return partials.groupBy("id").agg(best).select("id", "best.numerator", "best.denominator", "best.distance")


def nearest_distance(
    query: DataFrame,
    reference: DataFrame,
    id: str = "cmd_id",
    tokens: Column | None = None,
    normalised: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, numerator, denominator, distance)``: smallest distance of each query to any reference.

    The distance is (list sizes - 2 x set overlap), divided by the list sizes when
    ``normalised``; it is exact whatever tokens are shared, and 1 without a shared token.
    ``tokens`` is the token expression on both frames, by default the strict split of
    ``command``. Queries without tokens or without a reference get nulls. Queries that do not
    fit ``block_bytes`` go through :mod:`.setjoin`: joins on rare tokens, blocks for the rest.
    """
    tokens = tokens_strict(F.col("command")) if tokens is None else tokens
    scanner = partial(NearestOverlap, normalised=normalised)
    size = F.octet_length(F.array_join("tokens", "")) + 8 * F.size("tokens")

    def by_prefix(some: DataFrame, others: DataFrame) -> DataFrame:
        return nearest_sets(some, others, normalised)

    partials = block_join(
        _sides(query, id, tokens),
        _sides(reference, id, tokens),
        scanner,
        NearestOverlap.SCHEMA,
        size,
        block_bytes,
        by_prefix,
    )
    best = _smallest(partials)
    ids = query.select(F.col(id).cast("bigint").alias("id"))
    return ids.join(best, "id", "left").withColumnRenamed("id", id)


def filter_by_distance(
    new: DataFrame,
    base: DataFrame,
    min_distance: float = 4,
    id: str = "cmd_id",
    tokenizer: Callable[[Column], Column] = tokens_strict,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """New commands farther than ``min_distance`` (un-normalised) from every base command."""
    distances = nearest_distance(new, base, id, tokenizer(F.col("command")), False, block_bytes)
    far = distances.where(F.col("distance") > min_distance).select(id)
    return new.join(far, id, "left_semi")


def known_seeds(commands: DataFrame, seeds: Sequence[str] = DETECTOR_SEEDS) -> DataFrame:
    """``(command, tokens)`` of the seed commands, unknown tokens merged.

    Only the words of the seeds are looked up, in commands that contain them at all; the vocabulary
    is not built.
    """
    words = sorted({w for s in seeds for w in s.split()})
    spark = commands.sparkSession
    holds = reduce(Column.__or__, [F.contains("command", F.lit(w)) for w in words])
    found = (
        commands.where(holds)
        .select(F.explode(tokens_ws(F.col("command"))).alias("token"))
        .where(F.col("token").isin(words))
        .groupBy()
        .agg(F.collect_set("token").alias("known"))
    )
    known = found.first()["known"]
    rows = [(s, [t if t in known else UNKNOWN for t in s.split(" ")]) for s in seeds]
    return spark.createDataFrame(rows, "command string, tokens array<string>")


def encoded_tokens(command: Column, collapse_unknown: bool = True) -> Column:
    """Strict tokens; those the white-space vocabulary cannot hold (empty, or with other white
    space inside) become one shared unknown token."""
    tokens = tokens_strict(command)
    if not collapse_unknown:
        return tokens
    odd = lambda t: (t == "") | t.rlike(WHITESPACE_CLASS)
    return F.transform(tokens, lambda t: F.when(odd(t), F.lit(UNKNOWN)).otherwise(t))


def nearest_scores(
    normals: DataFrame,
    abnormals: DataFrame,
    n: int = 500,
    seed: int = 0,
    collapse_unknown: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(command, label, numerator, denominator, distance)`` of n normals and n abnormals.

    Distances are to the other normals and the seed commands. Frames hold distinct ``command``.
    """
    test_normal = sample_n(normals.select("command"), n, "command", seed)
    test_abnormal = sample_n(abnormals.select("command"), n, "command", seed)
    tests = test_normal.withColumn("label", F.lit(NORMAL)).unionByName(
        test_abnormal.withColumn("label", F.lit(ABNORMAL))
    )
    # The sample is small and used several times.
    numbered = hash_position(tests.withColumn("key", F.concat_ws("|", "label", "command")), "key", position="cmd_id")
    queries = cut_lineage(
        numbered.select(
            "cmd_id", "command", "label", encoded_tokens(F.col("command"), collapse_unknown).alias("tokens")
        )
    )
    held_out = queries.where(F.col("label") == NORMAL).select("command")
    train = set_minus(normals.select("command"), held_out).where("command <> ''")
    seeds = known_seeds(normals.select("command").unionByName(abnormals.select("command")))
    references = (
        train.select("command", encoded_tokens(strip(F.col("command")), collapse_unknown).alias("tokens"))
        .unionByName(seeds)
        .withColumn("cmd_id", F.monotonically_increasing_id())
    )
    distances = nearest_distance(
        queries, references, tokens=F.col("tokens"), block_bytes=block_bytes
    )
    return queries.select("cmd_id", "command", "label").join(distances, "cmd_id").drop("cmd_id")


def nearest_detector(
    normals: DataFrame, abnormals: DataFrame, n: int = 500, seed: int = 0, collapse_unknown: bool = True
) -> DataFrame:
    """Report of the nearest-distance detector for its 21 bounds."""
    return sweep_fraction(nearest_scores(normals, abnormals, n, seed, collapse_unknown))
