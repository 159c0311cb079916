"""The nearest reference of every query by token overlap: equi-joins on rare tokens, and blocks for the rest.

Distance is (list sizes - 2 x overlap), divided by the list sizes when normalised. Tokens are numbered by
document frequency among the references, rarest first, so a row is an ascending array of numbers and every row
reads its tokens in one global order. A query knows an upper bound of its answer: first that of sharing
nothing with the shortest reference, then that of the reference that shares most of its few rarest tokens. A bound
asks for a least overlap ``t``; of ``v`` known tokens, one of the first ``v - t + 1`` must then be shared. So

* a query whose prefix is short and rare (``NARROW``, ``RARE``) is joined to the references on its prefix; a pair
  met at positions ``i`` and ``j`` can share at most what is left of either row, and its list sizes must allow the
  bound, or it is dropped inside the join. It meets at most ``NARROW x RARE`` references, whose arrays are compared;
* all other queries would meet much of the references: they are compared block by block (:mod:`.cells`), where each
  task keeps one minimum per query and only blocks of list sizes that allow the bound are read.

Equal rows are compared once. Results are exact. What is stored and shuffled is some copies of the tokens, and one copy
of a side per block of the other; pairs are never more than a fixed number per query.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blockjoin import BLOCK_BYTES
from .cells import size_join
from .scanners import NearestOverlap

# Rarest tokens that look for a first bound.
PROBE_TOKENS = 6
# A token of so many references is rare; a prefix of so many rare tokens is joined.
RARE = 16
NARROW = 8


def _distinct_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tokens, size) once per content, and (id, rep) of every row; rows without tokens are left out."""
    some = df.where("size > 0").withColumn("tokens", F.sort_array("tokens"))
    unique = cut_lineage(some.groupBy("tokens", "size").agg(F.min("id").alias("rep")))
    return unique.select(F.col("rep").alias("id"), "tokens", "size"), some.join(unique, ["tokens", "size"]).select("id", "rep")


def _numbered_tokens(references: DataFrame) -> DataFrame:
    """(token, number, df): numbers rise with the document frequency. Sorted by ranges and stored."""
    held = references.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return cut_lineage(held.orderBy("df", "token").withColumn("number", F.monotonically_increasing_id()))


def _encoded(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, size, known): the numbers of a row's known tokens, rarest first."""
    each = rows.select("id", "size", F.explode("tokens").alias("token")).join(vocabulary.select("token", "number"), "token")
    return cut_lineage(each.groupBy("id", "size").agg(F.sort_array(F.collect_list("number")).alias("known")))


def _least_overlap(size: Column, num: Column, den: Column, normalised: bool) -> Column:
    """The overlap that a row of ``size`` tokens needs with any other to be no farther than ``num / den``."""
    if normalised:
        # 1 - 2 o / (a + b) <= num / den, and b >= o.
        return F.greatest(F.lit(1), F.ceil(size * (den - num) / (den + num) - 1e-9).cast("bigint"))
    return F.greatest(F.lit(1), size - num)


def _within(most: Column, sizes: Column, num: Column, den: Column, normalised: bool) -> Column:
    """Whether an overlap of ``most`` with list sizes of ``sizes`` together gets no farther than ``num / den``."""
    if normalised:
        return 2 * most * den >= (den - num) * sizes
    return sizes - 2 * most <= num


def _measured(pairs: DataFrame, queries: DataFrame, references: DataFrame, normalised: bool) -> DataFrame:
    """(q, num, den): the smallest distance among the pairs (q, r), counted on the token arrays."""
    left = queries.select(F.col("id").alias("q"), F.col("known").alias("kq"), F.col("size").alias("a"))
    right = references.select(F.col("id").alias("r"), F.col("known").alias("kr"), F.col("size").alias("b"))
    both = pairs.join(right, "r").join(left, "q")
    sizes = F.col("a") + F.col("b")
    num = sizes - 2 * F.size(F.array_intersect("kq", "kr"))
    den = sizes if normalised else F.lit(1)
    fraction = both.select("q", num.cast("bigint").alias("num"), den.cast("bigint").alias("den"))
    best = F.min(F.struct((F.col("num") / F.col("den")).alias("d"), "num", "den")).alias("best")
    return fraction.groupBy("q").agg(best).select("q", "best.num", "best.den")


def candidate_pairs(
    bounded: DataFrame, references: DataFrame, normalised: bool, below: int | None = None
) -> DataFrame:
    """Distinct (q, r) that may be no farther than the bounds in ``bounded`` (id, size, known, num, den).

    ``below``: all numbers in the prefixes are smaller, so only these are looked up.
    """
    num, den = F.col("num"), F.col("den")
    prefix = bounded.withColumn("t", _least_overlap(F.col("size"), num, den, normalised))
    first = prefix.select(
        F.col("id").alias("q"),
        F.col("size").alias("a"),
        "num",
        "den",
        F.size("known").alias("v"),
        F.posexplode(F.expr("slice(known, 1, greatest(0, size(known) - cast(t as int) + 1))")).alias("i", "number"),
    )
    postings = references.select(
        F.col("id").alias("r"),
        F.col("size").alias("b"),
        F.size("known").alias("w"),
        F.posexplode("known").alias("j", "number"),
    )
    if below is not None:
        postings = postings.where(F.col("number") < below)
    # At the first token they share a pair passes if it can be near enough; at later ones it need not.
    left = F.least(F.col("v") - F.col("i"), F.col("w") - F.col("j")).cast("bigint")
    met = first.join(postings, "number").where(_within(left, F.col("a") + F.col("b"), num, den, normalised))
    return met.select("q", "r").distinct()


def _probes(queries: DataFrame, references: DataFrame, below: int) -> DataFrame:
    """(q, r): the reference that shares most of the query's rarest tokens, if one of these is smaller than ``below``."""
    first = queries.select(F.col("id").alias("q"), F.explode(F.slice("known", 1, PROBE_TOKENS)).alias("number"))
    postings = references.select(F.col("id").alias("r"), F.explode("known").alias("number"))
    met = first.where(F.col("number") < below).join(postings.where(F.col("number") < below), "number")
    shared = met.groupBy("q", "r").agg(F.count("*").alias("n"))
    return shared.groupBy("q").agg(F.min_by("r", F.struct(-F.col("n"), F.col("r"))).alias("r"))


def nearest_sets(
    query: DataFrame, reference: DataFrame, normalised: bool = True, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, numerator, denominator) of the nearest row of ``reference`` for every row of ``query`` with tokens.

    Both have (id, tokens: distinct tokens, size: list size). No row if there is no reference with tokens.
    """
    queries, copies = _distinct_rows(query)
    references, _ = _distinct_rows(reference)
    vocabulary = _numbered_tokens(references)
    known, held = _encoded(queries, vocabulary), _encoded(references, vocabulary)
    # Numbers rise with the frequency: all tokens before the first one of more than RARE references are rare.
    frequent = vocabulary.where(F.col("df") > RARE).agg(F.min("number")).first()[0]
    below = (1 << 63) - 1 if frequent is None else frequent
    shortest = F.broadcast(references.agg(F.min("size").alias("b")).where("b is not null"))
    total = F.col("size") + F.col("b")
    nothing = queries.join(shortest).select(
        F.col("id").alias("q"),
        total.cast("bigint").alias("num"),
        (total if normalised else F.lit(1)).cast("bigint").alias("den"),
    )
    probed = cut_lineage(_measured(_probes(known, held, below), known, held, normalised))
    best = F.min(F.struct((F.col("num") / F.col("den")).alias("d"), "num", "den")).alias("best")

    def smallest(found: DataFrame) -> DataFrame:
        return found.groupBy("q").agg(best).select("q", "best.num", "best.den")

    bounds = cut_lineage(smallest(nothing.unionByName(probed)))
    bounded = known.join(bounds.withColumnRenamed("q", "id"), "id")
    least = _least_overlap(F.col("size"), F.col("num"), F.col("den"), normalised)
    prefix = F.greatest(F.lit(0), F.size("known") - least.cast("int") + 1)
    # A prefix of none means that no reference is nearer than the bound.
    narrow = (prefix <= NARROW) & F.coalesce(F.get("known", prefix - 1) < below, F.lit(True))
    split = cut_lineage(bounded.withColumn("narrow", narrow))
    pairs = cut_lineage(candidate_pairs(split.where("narrow").drop("narrow"), held, normalised, below))
    near = _measured(pairs, known, held, normalised)
    sides = [
        rows.select("id", F.col("known").alias("tokens"), "size") for rows in (split.where("not narrow"), held)
    ]
    scanned = size_join(
        *sides,
        partial(NearestOverlap, normalised=normalised),
        NearestOverlap.SCHEMA,
        8 * F.size("tokens"),
        block_bytes,
        normalised,
    ).select(F.col("id").alias("q"), F.col("numerator").alias("num"), F.col("denominator").alias("den"))
    answers = cut_lineage(smallest(bounds.unionByName(near).unionByName(scanned)))
    return copies.join(answers.withColumnRenamed("q", "rep"), "rep").select(
        "id", F.col("num").alias("numerator"), F.col("den").alias("denominator")
    )
