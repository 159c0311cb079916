"""Command files: labelled CSV, plain lists, table rows and text exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CHEAT_SHEET_RANGES, LABELLED_HEADER
from ..functions.text import nul_join, strip


def write_labelled_csv(df: DataFrame, path: str, command: str = "command", label: str = "label") -> None:
    """``cmdline,label`` lines under a header in every part file; empty commands are left out.

    The command is written as it is, so the last comma of a line always separates the label and
    :func:`read_labelled_csv` gets back what was written. Line breaks inside a command become
    blanks, since a line is a record.
    """
    text = nul_join(F.translate(F.col(command), "\n\r", "  "))
    rows = df.select(text.alias("command"), F.col(label).cast("string").alias("label"))
    lines = rows.where(F.col("command") != "").select(F.concat_ws(",", "command", "label").alias(LABELLED_HEADER))
    (
        lines.write.option("header", True)
        .option("quote", "")
        .option("escape", "")
        .option("sep", "\u0001")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_labelled_csv(spark: SparkSession, path: str | Sequence[str], host: str) -> DataFrame:
    """``(command, label, host)``: the label is what follows the last comma.

    Header lines and blank lines are skipped, commands cleaned of NULs, blank ones dropped.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    pattern = r"(?s)^(.*),([^,]*)$"
    return (
        lines.where((strip(F.col("value")) != "") & (F.col("value") != LABELLED_HEADER))
        .select(
            nul_join(F.regexp_extract("value", pattern, 1)).alias("command"),
            F.regexp_extract("value", pattern, 2).try_cast("int").alias("label"),
            F.lit(host).alias("host"),
        )
        .where(strip(F.col("command")) != "")
    )


def read_command_list(spark: SparkSession, *paths: str) -> DataFrame:
    """``(command)``: one trimmed command per line, blank lines dropped.

    The text reader also splits at bare carriage returns, which such lists use.
    """
    commands = spark.read.text(list(paths)).select(strip(F.col("value")).alias("command"))
    return commands.where(F.col("command") != "")


def select_row_ranges(
    df: DataFrame,
    position: str,
    value: str,
    ranges: Sequence[tuple[int, int | None]] = CHEAT_SHEET_RANGES,
) -> DataFrame:
    """Distinct ``value`` of the rows whose position lies in one of the inclusive ranges."""
    keep = F.lit(False)
    for first, last in ranges:
        inside = F.col(position) >= first
        keep = keep | (inside if last is None else inside & (F.col(position) <= last))
    return df.where(keep).select(F.col(value).alias("command")).distinct()


def write_commands(df: DataFrame, path: str, command: str = "command") -> None:
    """One command per line; line breaks inside a command become blanks."""
    df.select(F.translate(F.col(command), "\n\r", "  ").alias("value")).write.text(path)
