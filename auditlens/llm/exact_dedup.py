"""Exact duplicates with a heavy-hitter split; DataFrame operations only.

A Misra-Gries summary names every digest that may hold more than ``support`` of all rows (at most
1/support of them). Their exact counts are verified, and the winners are broadcast: the rows of a
text that makes up a third of the corpus are settled where they lie. All other digests go through
an ordinary shuffle, where no group can be larger than ``support`` of the rows.

* a null text counts as empty; runs of ASCII white space count as one space
* of equal texts the row with the smallest id stays; rows that repeat that very id stay with it, and
  in a group without any id all rows stay
* an empty table gives an empty result; other columns are never read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACES, unused_names

SUPPORT = 0.001


def normalised_sha256(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep, group_size) of digests on at least ``support`` of the rows: 1/support rows at most."""
    summary = digests.freqItems(["digest"], support)
    candidates = summary.select(F.explode("digest_freqItems").alias("digest"))
    counted = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("keep"), F.count("*").alias("group_size"))
    )
    total = digests.agg(F.count("*").alias("total"))
    return stored(
        counted.join(F.broadcast(total)).where(F.col("group_size") >= F.col("total") * support).drop("total"),
        "winners",
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """(id, keep, group_size, digest) for every row of ``docs``."""
    digests = stored(docs.select(F.col(key).alias("id"), normalised_sha256(F.col(text)).alias("digest")), "digests")
    winners = F.broadcast(frequent_digests(digests, support))
    heavy = digests.join(winners, "digest")
    light = digests.join(winners.select("digest"), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("group_size"))
    return heavy.unionByName(light.join(groups, "digest")).select("id", "keep", "group_size", "digest")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay. Rows without an id cannot be told apart and always stay.

    A row is dropped by its id and its digest: an id that also occurs with another text keeps that row.
    """
    groups = exact_groups(docs, key, text)
    copies = groups.where(F.col("id") != F.col("keep"))
    name, digest = unused_names(docs, "_id", "_digest")
    dropped = copies.select(F.col("id").alias(name), F.col("digest").alias(digest)).distinct()
    same = (docs[key] == F.col(name)) & (normalised_sha256(docs[text]) == F.col(digest))
    return docs.join(dropped, same, "left_anti")
