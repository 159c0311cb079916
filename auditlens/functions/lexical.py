"""The 22 lexical counters of a process-audit command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEXICAL_COUNTERS
from .text import char_entropy, nul_to_space, substr_count, tokens_ws

LEXICAL_COLUMNS = ("len", "paramnum", "entropy") + tuple(c[0] for c in LEXICAL_COUNTERS)

PROCESS_COLUMNS = ("cexe", "cname", "cpid", "pcmdline", "pexe", "pname", "ppid")


def lexical_columns(command: Column) -> list[Column]:
    """The 22 features as columns."""
    counters = [
        (substr_count(command, needle) / divisor if divisor > 1 else substr_count(command, needle))
        .cast("double")
        .alias(name)
        for name, needle, divisor in LEXICAL_COUNTERS
    ]
    return [
        (F.length(command) - 1).cast("double").alias("len"),
        F.size(tokens_ws(command)).cast("double").alias("paramnum"),
        char_entropy(command).alias("entropy"),
        *counters,
    ]


def lexical_features(df: DataFrame, parent: str = "java") -> DataFrame:
    """Commands started by ``parent`` with their features; the other process columns go."""
    rows = df.where((F.col("pname") == parent) & (F.col("ccmdline") != "")).withColumn(
        "ccmdline", nul_to_space(F.col("ccmdline"))
    )
    kept = [c for c in rows.columns if c not in PROCESS_COLUMNS]
    return rows.select(*kept, *lexical_columns(F.col("ccmdline")))
