"""Reproducible positions, samples, splits and caps.

Everything is ordered by md5(seed|key), so a pick is independent of partitioning and of retries,
and the uniform leading digits of the hash give a partitioning that no data can skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PATTERN_CAP, REPETITIVE_PATTERNS
from ..functions.common import HASH_RANGE, hash_hex, hash_uint32
from ..session import cut_lineage

BUCKET_DIGITS = 4


def _range(n: int) -> Column:
    """The numbers 0 .. n - 1 as an array."""
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def hash_position(
    df: DataFrame, key: str, seed: int = 0, upto: int | None = None, position: str = "position"
) -> DataFrame:
    """Number the rows 1, 2, ... in md5 order of a unique key, without a global sort.

    Rows are bucketed by the first hash digits and ranked inside their bucket; the offset of a
    bucket comes from the bucket counts, at most 65,536 rows whatever the data size. With ``upto``
    buckets that start beyond it are dropped before anything is ranked, so a sample of n rows
    shuffles about n rows. ``df`` is read twice, the first time for its key only.
    """
    tagged = df.withColumn("_hash", hash_hex(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    counts = (
        df.select(F.substring(hash_hex(F.col(key), seed), 1, BUCKET_DIGITS).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
    )
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    if upto is not None:
        offsets = offsets.where(F.col("_offset") < upto)
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    ranked = (
        tagged.join(offsets, "_bucket")
        .withColumn(position, F.row_number().over(inside) + F.col("_offset"))
        .select(*df.columns, position)
    )
    return ranked if upto is None else ranked.where(F.col(position) <= upto)


def range_position(df: DataFrame, order: Sequence[str], position: str = "position") -> DataFrame:
    """Number the rows 1, 2, ... in the order of given columns.

    A range-partitioned sort is written to the shared folder once; the row index inside a partition
    comes for free and only one count per partition is added up. End the order with a unique
    column, so that rows equal in the others can be split over partitions.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut_lineage(parts.withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright("_mono", 33)
    index = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    return (
        numbered.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(position, index + F.col("_offset") + 1)
        .select(*df.columns, position)
    )


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (all when there are fewer)."""
    return hash_position(df, key, seed, upto=n).drop("position")


def shuffle(df: DataFrame, key: str, seed: int = 0, order: str = "shuffle_key") -> DataFrame:
    """Add the hash that defines the shuffled order; sort by it only where order matters."""
    return df.withColumn(order, hash_hex(F.col(key), seed))


def below_fraction(key: Column, fraction: float, seed: int | str) -> Column:
    """Whether the key's hash falls in the first ``fraction`` of the hash range."""
    return hash_uint32(key, seed) < int(fraction * HASH_RANGE)


def train_test_split(
    df: DataFrame, fraction: float, key: str, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a row-wise decision, so nothing is shuffled."""
    test = below_fraction(F.col(key), fraction, seed)
    return df.where(~test), df.where(test)


def take_skip(df: DataFrame, n: int, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first n rows in shuffled order, and all others."""
    ranked = hash_position(df, key, seed)
    first = F.col("position") <= n
    return ranked.where(first).drop("position"), ranked.where(~first).drop("position")


def k_fold(
    df: DataFrame, k: int, key: str, seed: int = 0, shuffled: bool = True, fold: str = "fold"
) -> DataFrame:
    """Add a fold id 0..k-1; fold sizes differ by one at most, larger ones first.

    ``shuffled=False`` makes contiguous folds in key order, which are single-class folds when
    the keys follow the classes.
    """
    ranked = hash_position(df, key, seed) if shuffled else range_position(df, [key])
    size, larger = divmod(df.count(), k)
    index = F.col("position") - 1
    edge = larger * (size + 1)
    behind = F.floor((index - edge) / max(size, 1)) + larger
    return ranked.withColumn(
        fold, F.when(index < edge, F.floor(index / (size + 1))).otherwise(behind).cast("bigint")
    ).drop("position")


def shuffle_split(df: DataFrame, splits: int, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Independent random splits: each row once per split with ``split`` and ``is_test``."""
    tagged = df.withColumn("split", F.explode(_range(splits)))
    return tagged.withColumn(
        "is_test",
        below_fraction(F.concat_ws("|", F.col("split"), F.col(key)), fraction, seed),
    )


def bagging_chunks(
    normals: DataFrame, abnormals: DataFrame, key: str, chunk: int = 1000, step: int = 6000, seed: int = 0
) -> DataFrame:
    """Training rows of an ensemble: model i gets normals ``[i*chunk, (i+1)*chunk)`` and all
    abnormals; there is one model per ``step`` normals."""
    models = normals.count() // step
    if models == 0:
        return normals.unionByName(abnormals).limit(0).withColumn("model", F.lit(0).cast("bigint"))
    chunks = (
        hash_position(normals, key, seed, upto=models * chunk)
        .withColumn("model", F.floor((F.col("position") - 1) / chunk).cast("bigint"))
        .drop("position")
    )
    return chunks.unionByName(abnormals.withColumn("model", F.explode(_range(models))))


def pattern_of(command: Column, patterns: Sequence[tuple[str, str]] = REPETITIVE_PATTERNS) -> Column:
    """Name of the first pattern that matches, or null."""
    name = F.when(command.rlike(patterns[0][1]), patterns[0][0])
    for label, regex in patterns[1:]:
        name = name.when(command.rlike(regex), label)
    return name


def cap_patterns(
    df: DataFrame,
    patterns: Sequence[tuple[str, str]] = REPETITIVE_PATTERNS,
    n: int = PATTERN_CAP,
    command: str = "command",
    salts: int = 1024,
) -> DataFrame:
    """At most n rows of each repetitive pattern; all other rows are kept.

    Rows without a pattern are not shuffled. A pattern may hold much of the data: it is first cut
    to n rows in each of ``salts`` hash slices, then to n rows overall, so no task sees the group.
    """
    named = df.withColumn("_pattern", pattern_of(F.col(command), patterns))
    plain = named.where("_pattern is null")
    ranked = named.where("_pattern is not null").withColumn("_hash", hash_hex(F.col(command)))
    ranked = ranked.withColumn("_salt", hash_uint32(F.col(command), "salt") % salts)
    order = ["_hash", command]
    for part in (["_pattern", "_salt"], ["_pattern"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        ranked = ranked.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return plain.select(*df.columns).unionByName(ranked.select(*df.columns))
