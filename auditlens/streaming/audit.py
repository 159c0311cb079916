"""Streaming scan with the schema of the batch reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.audit import AUDIT_SCHEMA, CORRUPT


def stream_audit(spark: SparkSession, path: str, host: str, pattern: str = "*") -> DataFrame:
    """Audit records of files as they arrive below ``path``. Stateless: score them with the
    column functions or join them to a stored model."""
    return (
        spark.readStream.schema(AUDIT_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .withColumn("host", F.lit(host))
    )
