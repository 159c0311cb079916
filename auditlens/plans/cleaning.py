"""From raw logs and documentation pages to a labelled, balanced command set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ABNORMAL, DATASET_SEEDS, EXAMPLE_TITLES, NORMAL, PATTERN_CAP, REPETITIVE_PATTERNS
from ..functions.markup import extract_blocks
from ..functions.text import clean_prompt_comment, clean_prompt_redirect, command_length, nul_to_space, strip
from ..operators.aggregates import class_counts, java_report, length_buckets, length_histogram, program_histogram
from ..operators.nearest import filter_by_distance
from ..operators.sampling import cap_patterns, hash_position, pattern_of, shuffle
from ..operators.sets import (
    add_seed_rows,
    augment_sudo,
    filter_by_program,
    label_union,
    not_in,
    set_minus,
    split_classes,
    strip_commands,
)
from ..session import cut_lineage


def build_dataset(normal_logs: DataFrame, abnormal_logs: DataFrame, seed: int = 0) -> DataFrame:
    """``(command, label, shuffle_key)``: distinct commands of both record sets, NULs as blanks."""
    normal, abnormal = (
        logs.select(nul_to_space(F.col("ccmdline")).alias("command")).where("command is not null").distinct()
        for logs in (normal_logs, abnormal_logs)
    )
    return shuffle(label_union(normal, abnormal), "command", seed)


@dataclass(frozen=True)
class CleanNormals:
    """The cleaned commands and the counts reported on the way."""

    commands: DataFrame
    pattern_counts: DataFrame
    java_counts: DataFrame


def clean_normals(
    normals: DataFrame,
    abnormals: DataFrame,
    patterns: Sequence[tuple[str, str]] = REPETITIVE_PATTERNS,
    n: int = PATTERN_CAP,
) -> CleanNormals:
    """Distinct normals without known abnormals, repetitive patterns capped; java commands are
    only counted, not rewritten. The distinct normals are stored once and used for all of it."""
    remaining = cut_lineage(set_minus(normals.select("command"), abnormals.select("command")))
    capped = cap_patterns(remaining, patterns, n)
    found = remaining.select(pattern_of(F.col("command"), patterns).alias("pattern"))
    return CleanNormals(capped, class_counts(found.where("pattern is not null"), "pattern"), java_report(capped))


def additional_abnormals(*lists: DataFrame) -> DataFrame:
    """Distinct commands of all lists, each also with ``sudo`` in front."""
    commands = lists[0].select("command")
    for more in lists[1:]:
        commands = commands.unionByName(more.select("command"))
    trimmed = commands.select(strip(F.col("command")).alias("command")).where("command <> ''")
    return augment_sudo(trimmed.distinct()).distinct()


def extend_abnormals(
    df: DataFrame,
    new: DataFrame,
    min_distance: float | None = None,
    drop_known_programs: bool = False,
) -> DataFrame:
    """``(command, label)``: the labelled set plus new abnormals (also with ``sudo``) that are not
    known as normal; optionally only those far from every normal, or running a new program."""
    normal, abnormal = split_classes(df)
    candidates = not_in(augment_sudo(new), normal, "command")
    if min_distance is not None:
        numbered = hash_position(candidates.distinct(), "command", position="cmd_id")
        base = hash_position(normal.select("command").distinct(), "command", position="cmd_id")
        far = filter_by_distance(numbered, base, min_distance)
        candidates = candidates.join(far.select("command"), "command", "left_semi")
    if drop_known_programs:
        candidates = filter_by_program(candidates, normal)
    return label_union(normal, abnormal.select("command").unionByName(candidates.select("command")))


def finalise(df: DataFrame, seeds: Sequence[str] = DATASET_SEEDS) -> DataFrame:
    """Trim all commands, drop empty ones, add the seed normals."""
    return add_seed_rows(strip_commands(df).select("command", "label"), seeds)


def pages_to_commands(
    pages: DataFrame,
    style: str = "comment",
    page_id: str = "page_id",
    html: str = "html",
    heading_tags: Sequence[str] | None = None,
    titles: Sequence[str] | None = None,
    block_tag: str = "pre",
) -> DataFrame:
    """``(page_id, block, line_no, command)`` of the examples on documentation pages.

    ``comment``: every line of the blocks behind a titled heading, cleaned of comments and prompts.
    ``redirect``: the first line of each block behind the last heading, cleaned of prompts and
    redirections.
    """
    if style == "comment":
        tags, words = heading_tags or ("h3", "h2"), titles or EXAMPLE_TITLES
        lines, clean = "all", clean_prompt_comment
    else:
        tags, words = heading_tags or ("h3",), titles
        lines, clean = "first", clean_prompt_redirect
    blocks = extract_blocks(pages, page_id, html, tags, words, block_tag, lines)
    commands = blocks.where("line <> ''").select(page_id, "block", "line_no", clean(F.col("line")).alias("command"))
    return commands.where("command is not null")


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """Programs, token lengths, length buckets and long commands, each per class."""
    tables: dict[str, DataFrame] = {}
    for name, rows in zip(("normal", "abnormal"), split_classes(df), strict=True):
        tables[f"{name}_programs"] = program_histogram(rows)
        tables[f"{name}_lengths"] = length_histogram(rows)
        tables[f"{name}_buckets"] = length_buckets(rows)
        tables[f"{name}_long"] = rows.where(F.length("command") > 1000)
    return tables


def profile_table(df: DataFrame, width: int = 5) -> DataFrame:
    """``(label, bucket, commands, characters, over_1000)``: the profile per class in one pass."""
    low = F.floor(command_length(F.col("command")) / width) * width
    return df.where(F.col("label").isin(NORMAL, ABNORMAL)).groupBy(
        "label", F.concat(low.cast("string"), F.lit("s")).alias("bucket")
    ).agg(
        F.count("*").alias("commands"),
        F.sum(F.length("command")).cast("bigint").alias("characters"),
        F.count_if(F.length("command") > 1000).alias("over_1000"),
    )
