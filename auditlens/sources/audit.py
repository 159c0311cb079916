"""Process-audit logs: JSON lines, one record per started process."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import AUDIT_FIELDS

CORRUPT = "corrupt_record"

AUDIT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in (*AUDIT_FIELDS, CORRUPT)])


def _pattern(patterns: Sequence[str]) -> str:
    return patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"


def _outside(exclude_dirs: Sequence[str]) -> Column:
    path = F.col("_metadata.file_path")
    keep = F.lit(True)
    for name in exclude_dirs:
        keep = keep & ~F.contains(path, F.lit(f"/{name}/"))
    return keep


def read_audit(
    spark: SparkSession,
    path: str | Sequence[str],
    host: str,
    patterns: Sequence[str] = ("*",),
    exclude_dirs: Sequence[str] = (),
    min_partitions: int | None = None,
) -> DataFrame:
    """Audit records below ``path`` with ``host`` and ``source_file``.

    Malformed lines keep their text in ``corrupt_record``. Gzip files are read as they are; one
    such file is one task, so give ``min_partitions`` to spread its rows before heavy work.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = (
        spark.read.schema(AUDIT_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _pattern(patterns))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
        .where(_outside(exclude_dirs))
        .select("*", F.lit(host).alias("host"), F.col("_metadata.file_path").alias("source_file"))
    )
    return df.repartition(min_partitions) if min_partitions else df


def source_size(
    spark: SparkSession, path: str | Sequence[str], patterns: Sequence[str] = ("*",)
) -> DataFrame:
    """``(file, size_mb)`` per file and a ``total`` row, in MB with two decimals.

    Reads no content: only file names and lengths are listed.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _pattern(patterns))
        .load(paths)
        .select(F.col("path").alias("file"), F.col("length").alias("size"))
    )
    return files.rollup("file").agg(F.sum("size").alias("size")).select(
        F.coalesce("file", F.lit("total")).alias("file"),
        F.round(F.coalesce("size", F.lit(0)) / 1048576, 2).alias("size_mb"),
    )
