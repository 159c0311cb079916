"""What several corpus operators share: words, bounded slots, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc32_of(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as a non-negative number; that of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def row_key(df: DataFrame) -> Column:
    """128 bits of a row's whole content: equal rows share it, and nulls tell columns apart."""
    values = [part for c in df.columns for part in (F.isnull(df[c]), df[c])]
    return F.struct(F.xxhash64(F.lit(91), *values).alias("a"), F.xxhash64(F.lit(92), *values).alias("b"))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores behind those that are columns of ``df``, whose case does not count."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def numbered(df: DataFrame, groups: list[str], key: str, slot: str, per_bucket: int = 1000) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps inside each group, whatever the group's size.

    A group is cut into hash buckets of about ``per_bucket`` rows; rows are ranked inside their bucket
    and start at the number of rows in the buckets before it. ``df`` is read three times, so give a
    stored one. Rows equal in ``key`` get different slots in any order.
    """
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_rows"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / per_bucket)).cast("int")
    tagged = _null_safe_join(df, sizes.select(*groups, buckets.alias("_buckets")), groups).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.lit(11), key), F.col("_buckets")).cast("int")
    )
    counts = tagged.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(F.xxhash64(F.lit(12), key), key)
    return (
        _null_safe_join(tagged, offsets, [*groups, "_bucket"])
        .withColumn(slot, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint"))
        .select(*df.columns, slot)
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; keeps the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        match = same if i == 0 else match & same
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


null_safe_join = _null_safe_join


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: float = 0.001) -> DataFrame:
    """Join ``rows`` with ``groups``, unique per key, where ``size`` is a group's number of rows.

    Groups with more than ``share`` of all rows (at most 1/share of them) are broadcast, so that a key with
    a third of the rows is joined where its rows lie; the others are shuffled. Both frames are read twice.
    """
    total = F.broadcast(groups.agg((F.sum(size) * share).alias("_least")))
    tagged = groups.join(total)
    heavy = F.broadcast(tagged.where(F.col(size) > F.col("_least")).drop("_least"))
    light = tagged.where(F.col(size) <= F.col("_least")).drop("_least")
    rest = rows.join(heavy.select(*keys), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(light, keys))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternating stars: the larger neighbours of a node, then the smaller ones, are linked to the
    smallest of the neighbourhood, until the links no longer change. Each half is one minimum per node
    (combined before the shuffle) and one join whose hot side adaptive execution can split, so a hub
    with a third of all nodes is not one task. Links are stored after every round; a chain of n nodes
    takes about log n rounds. Raises if ``max_rounds`` do not suffice.
    """
    links = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = _fingerprint(links)
    for _ in range(max_rounds):
        links = stored(_small_star(_large_star(links)), "links")
        now = _fingerprint(links)
        if now == before:
            nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
