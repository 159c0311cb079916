"""Filters, set algebra and class handling on command frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ABNORMAL, NORMAL
from ..functions.text import program_name, strip
from ..session import cut_lineage


def non_empty(df: DataFrame, command: str = "command") -> DataFrame:
    """Rows with a command."""
    return df.where(F.col(command) != "")


def strip_commands(df: DataFrame, command: str = "command") -> DataFrame:
    """Trim the command of every row that has one."""
    return non_empty(df, command).withColumn(command, strip(F.col(command)))


def split_classes(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """The normal and the abnormal rows."""
    return df.where(F.col(label) == NORMAL), df.where(F.col(label) == ABNORMAL)


def dedupe(df: DataFrame, command: str = "command") -> DataFrame:
    """Distinct commands. Aggregates before the shuffle, so copies collapse where they are read."""
    return df.select(command).distinct()


def set_union(*frames: DataFrame) -> DataFrame:
    """Distinct rows of all frames."""
    return reduce(DataFrame.unionByName, frames).distinct()


def set_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``; copies collapse before the join."""
    return left.distinct().subtract(right.distinct())


def not_in(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows whose key does not occur in ``known``; row multiplicity is kept.

    The known keys are made unique and stored, so that both sides of the join come straight from a
    shuffle: that is what lets adaptive execution split a hot key on the left.
    """
    return df.join(cut_lineage(known.select(on).distinct()), on, "left_anti")


def remove_conflicts(
    df: DataFrame, keep: int = ABNORMAL, command: str = "command", label: str = "label"
) -> DataFrame:
    """Commands seen in both classes stay only in class ``keep``."""
    kept = df.where(F.col(label) == keep)
    others = df.where(F.col(label) != keep)
    return kept.unionByName(not_in(others, kept, command).select(*df.columns))


def label_union(
    normal: DataFrame, abnormal: DataFrame, command: str = "command", label: str = "label"
) -> DataFrame:
    """Both classes in one labelled frame."""
    return normal.select(command, F.lit(NORMAL).alias(label)).unionByName(
        abnormal.select(command, F.lit(ABNORMAL).alias(label))
    )


def augment_sudo(df: DataFrame, command: str = "command") -> DataFrame:
    """The commands, and ``sudo <command>`` for each that does not start with it."""
    plain = df.select(command).where(strip(F.col(command)) != "")
    raised = plain.where(F.substring_index(command, " ", 1) != "sudo").select(
        F.concat(F.lit("sudo "), F.col(command)).alias(command)
    )
    return plain.unionByName(raised)


def add_seed_rows(
    df: DataFrame, seeds: Sequence[str], command: str = "command", label: str = "label"
) -> DataFrame:
    """Append commands that are always known as normal."""
    rows = df.sparkSession.createDataFrame([(s,) for s in seeds], f"`{command}` string")
    if label in df.columns:
        rows = rows.withColumn(label, F.lit(NORMAL).cast(df.schema[label].dataType))
    return df.unionByName(rows, allowMissingColumns=True)


def filter_by_program(new: DataFrame, base: DataFrame, command: str = "command") -> DataFrame:
    """New commands whose program no base command runs; commands without a program stay."""
    programs = base.select(program_name(F.col(command)).alias("program")).where("program is not null")
    return not_in(
        new.withColumn("program", program_name(F.col(command))), programs, "program"
    ).drop("program")


def long_commands(df: DataFrame, length: int = 1000, command: str = "command") -> DataFrame:
    """Commands of more than ``length`` characters."""
    return df.where(F.length(command) > length)
