"""Command normalisation, tokens and lexical measures."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..constants import ABNORMAL, NORMAL, WHITESPACE, WHITESPACE_CLASS
from .common import bind

NUL = "\u0000"


def nul_to_space(command: Column) -> Column:
    """Turn NUL-separated arguments into blank-separated ones; a trailing NUL stays a blank."""
    return F.translate(command, NUL, " ")


def nul_join(command: Column) -> Column:
    """Drop NULs at both ends, then join the arguments with blanks."""
    return F.translate(F.btrim(command, F.lit(NUL)), NUL, " ")


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def json_field(record: Column, path: str) -> Column:
    """One field of a JSON record as text; null when absent or malformed."""
    return F.get_json_object(record, path)


def tokens_strict(command: Column) -> Column:
    """Split at each single blank; neighbouring blanks give empty tokens."""
    return F.split(command, " ")


def tokens_ws(command: Column) -> Column:
    """Split at runs of white space; no empty tokens."""
    return F.filter(F.split(command, WHITESPACE_CLASS + "+"), lambda t: t != "")


def tokens_word(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, the TF-IDF terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def tokens_alnum(text: Column) -> Column:
    """Runs of word characters, case kept, the sequence-model tokens."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)


def ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams; null when there are fewer than n tokens."""
    if n == 1:
        return F.when(F.size(tokens) >= 1, tokens)
    return bind(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))),
                lambda i: F.array_join(F.slice(t, i, n), " "),
            ),
        ),
    )


def program_path(command: Column) -> Column:
    """The program a command runs: its first token, or behind a shell the first non-flag.

    Null for an empty command and for a shell that has only flags.
    """

    def pick(t: Column) -> Column:
        head = F.get(t, F.lit(0))
        behind_shell = F.filter(
            F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda x: ~F.startswith(x, F.lit("-"))
        )
        is_shell = head.endswith("bash") | (head == "sh") | head.endswith("/sh")
        return F.when(is_shell, F.get(behind_shell, F.lit(0))).otherwise(head)

    return F.when(command != "", bind(tokens_strict(command), pick))


def program_name(command: Column) -> Column:
    """Base name of :func:`program_path`."""
    return F.substring_index(program_path(command), "/", -1)


def is_java(command: Column) -> Column:
    """Whether the base name of the first token is ``java``."""
    return F.substring_index(F.substring_index(command, " ", 1), "/", -1) == "java"


def canonical_java(command: Column) -> Column:
    """``java <arguments>`` whatever path the program was started from."""
    arguments = bind(
        tokens_strict(command),
        lambda t: F.array_join(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), " "),
    )
    return F.when(is_java(command), F.concat(F.lit("java "), arguments)).otherwise(command)


def clean_prompt_comment(line: Column) -> Column:
    """Command of a documentation line, comment style: drops comment lines and a shell prompt
    in front of ``#``, ``$`` or ``//``. Null when the line holds no single command."""
    text = strip(line)

    def pick(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return (
            F.when((F.size(p) == 2) & F.contains(first, F.lit("[")), strip(second))
            .when(F.size(p).isin(1, 2), first)
            .when(F.size(p) == 3, second)
        )

    parts = F.filter(F.split(text, r"[#$]|//"), lambda x: x != "")
    skipped = F.startswith(text, F.lit("#")) | F.startswith(text, F.lit("//"))
    return F.when(~skipped, bind(parts, pick))


def clean_prompt_redirect(line: Column) -> Column:
    """Command of a documentation line, redirect style: splits at ``#``, ``$``, ``>`` and ``<``,
    trims every part. Null when the line holds no single command."""

    def pick(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return (
            F.when((F.size(p) == 2) & F.contains(first, F.lit("[")), strip(second))
            .when(F.size(p).isin(1, 2), strip(first))
            .when(F.size(p) == 3, strip(second))
        )

    parts = F.filter(F.split(strip(line), r"[#$><]"), lambda x: x != "")
    return F.nullif(bind(parts, pick), F.lit(""))


def command_length(command: Column) -> Column:
    """Length in blank-separated tokens."""
    return F.size(tokens_strict(command))


@F.arrow_udf(DoubleType())
def _entropies(texts: pa.Array) -> pa.Array:
    """Characters are counted by C code, a text at a time; shares are added up in order of first occurrence."""

    def entropy(text: str) -> float:
        total, size = 0.0, len(text)
        for char in dict.fromkeys(text):
            share = text.count(char) / size
            total -= share * math.log2(share)
        return total

    return pa.array((None if t is None else entropy(t) for t in texts.to_pylist()), pa.float64())


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, rounded to 7 digits; 0 for empty text."""
    return F.round(_entropies(text), 7)


def substr_count(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")


def signed_label(label: Column) -> Column:
    """+1 for normal, -1 for abnormal."""
    return F.when(label == NORMAL, F.lit(1)).when(label == ABNORMAL, F.lit(-1))


def clean_category(category: Column) -> Column:
    """``A | B`` becomes ``AB``; numbering in front of the ideographic comma goes."""
    return F.substring_index(F.replace(category, F.lit(" | "), F.lit("")), "、", -1)


def absolute_url(url: Column, base: str) -> Column:
    """Prefix a link that has no slash of its own."""
    return F.when(F.contains(url, F.lit("/")), url).otherwise(F.concat(F.lit(base), url))
