"""Mix sources to target weights by entropy balancing.

Every document gets a rate exp(lambda of its source): of all rates that meet the token constraints,
these are nearest to 1 in (token-weighted) relative entropy. The dual is convex and, as a document has
one source, its Hessian is diagonal: the sums over documents are taken once in parallel, and each
source's Newton steps run in its own row. Rates become whole copies by error diffusion along falling
document size, so what a source takes misses its target by less than its smallest documents.

* size is the number of words, 0 for null or blank texts; such documents take nothing
* a null source is a source of its own, last in order; an empty table gives an empty result
* documents of equal source and size are told apart by a hash of their id: reruns agree; rows equal in
  all of these are interchangeable
* other columns are never read
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import join_groups, n_words, null_safe_join, row_key, unused_names

NEWTON_STEPS = 80
TOLERANCE = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target): shares of all tokens by weight, none above ``most`` x its source.

    ``sizes`` has source and size. What a capped source leaves is shared by weight among the others
    until none is above: with sources ordered by cap / weight the capped ones are a prefix, so the
    water level is found with two running sums over the table of sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    levels = F.array(*[F.lit(float(w)) for w in weights])
    weighted = by_source.withColumn(
        "w", F.get(levels, (F.row_number().over(order) - 1) % len(weights))
    ).withColumn("cap", F.col("source_size") * float(most))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(upto), F.lit(0.0))
    level = (F.sum("source_size").over(every) - before("cap")) / (F.sum("w").over(every) - before("w"))
    ranked = weighted.withColumns({"level": level, "place": F.row_number().over(rising)})
    # The first source in order whose cap is not reached sets the water level for it and all later ones.
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("place", "level"))).over(every)
    return ranked.withColumn("water", first["level"]).select(
        "source",
        "source_size",
        F.when(F.col("water").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("water") * F.col("w")))
        .alias("target"),
    )


def dual_rate(total: Column, target: Column, most: float) -> Column:
    """exp(lambda) where lambda minimises total * exp(lambda) - target * lambda, by Newton's method.

    It starts above the solution, from where Newton falls monotonically. Raises when the constraint
    is not met after ``NEWTON_STEPS`` steps.
    """

    def step(x: Column, _: Column) -> Column:
        moved = total * F.exp(x)
        return x - (moved - target) / moved

    start = F.lit(float(most)).cast("double")
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.log(start), step)
    met = F.abs(total * F.exp(lam) - target) <= TOLERANCE * target
    return (
        F.when((total <= 0) | (target <= 0), F.lit(0.0))
        .when(met, F.exp(lam))
        .otherwise(F.raise_error(F.lit("Newton steps did not meet a token constraint")).cast("double"))
    )


def _diffuse(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies per (source, size) cell; ``cells`` holds one source: a row per distinct size."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    most, carry, copies = int(cells["most"].iloc[0]), 0.0, []
    for size, rows, rate in zip(cells["size"], cells["rows"], cells["rate"], strict=True):
        want = rate * rows * size + carry
        taken = min(max(0, int(want / size + 0.5)), most * int(rows)) if size else 0
        carry = want - taken * size
        copies.append(taken)
    return cells.assign(copies=copies)[["source", "size", "rows", "copies"]]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    per_salt: int = 256,
) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for every row of ``docs``."""
    groups = mix_groups(docs, weights, most, key, text, source, per_salt)
    each, more = F.col("copies") / F.col("same"), F.col("copies") % F.col("same")
    rows = groups.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("same"))))
    return rows.withColumn("copies", F.floor(each) + (F.col("_row") <= more).cast("bigint")).drop("same", "_row")


def mix_groups(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    per_salt: int = 256,
) -> DataFrame:
    """(id, source, size, source_size, target, rate, same, copies): ``same`` rows of ``docs`` are equal in id,
    source and size, and take ``copies`` together. They are counted before any shuffle by cell."""
    sized = stored(
        docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
        .groupBy("id", "source", "size")
        .agg(F.count("*").alias("same")),
        "sizes",
    )
    sources = stored(
        source_targets(
            sized.select("source", (F.col("size") * F.col("same")).alias("size")), weights, most
        ).withColumn(
            "rate", dual_rate(F.col("source_size"), F.col("target"), most)
        ),
        "sources",
    )
    # At most one row per distinct size and source, however many documents there are.
    histogram = sized.groupBy("source", "size").agg(F.sum("same").alias("rows"))
    cells = null_safe_join(histogram, sources.select("source", "rate"), ["source"]).withColumn(
        "most", F.lit(int(most))
    )
    granted = stored(
        cells.groupBy("source").applyInPandas(_diffuse, "source string, size long, rows long, copies long"),
        "granted",
    )
    # Which of a cell's rows get one copy more: the cell is cut into salts of bounded size, every salt
    # gets its share of the extra copies, and inside a salt the smallest hashes win.
    salts = F.ceil(F.col("rows") / per_salt).cast("int")
    cell = ["source", "size"]
    tagged = null_safe_join(sized, granted, cell).withColumn(
        "salt", F.pmod(F.xxhash64(F.lit(21), "id"), salts).cast("int")
    )
    counts = tagged.groupBy(*cell, "salt").agg(
        F.sum("same").alias("n"), F.max("rows").alias("rows"), F.max("copies").alias("copies")
    )
    running = Window.partitionBy(*cell).orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(running)
    extra = F.col("copies") % F.col("rows")

    def share(n: Column) -> Column:
        return F.floor(n.cast("decimal(38,0)") * extra / F.col("rows")).cast("bigint")

    shares = counts.withColumn("upto", upto).select(
        *cell, "salt", (share(F.col("upto")) - share(F.col("upto") - F.col("n"))).alias("extra")
    )
    inside = Window.partitionBy(*cell, "salt").orderBy(F.xxhash64(F.lit(22), "id"), "id")
    before = F.sum("same").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("same")
    picked = null_safe_join(tagged, shares, [*cell, "salt"]).withColumn("before", before)
    favoured = F.greatest(F.lit(0), F.least("same", F.col("extra") - F.col("before")))
    copies = F.floor(F.col("copies") / F.col("rows")) * F.col("same") + favoured
    return null_safe_join(
        picked.select("id", *cell, "same", copies.cast("bigint").alias("copies")), sources, ["source"]
    ).select("id", "source", "size", "source_size", "target", "rate", "same", "copies")


def take_mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, whatever ids are null or repeat.

    Rows are told apart by their whole content. Rows that no other equals are repeated where the join finds
    them; of equal rows one stands for all and is repeated as often as they are taken together.
    """
    key, same, copies, copy = unused_names(docs, "_key", "_same", "_copies", "_copy")
    keyed = docs.withColumn(key, row_key(docs))
    mix = mix_groups(keyed, key=key, **options)
    taken = stored(
        mix.where("copies > 0").select(F.col("id").alias(key), F.col("same").alias(same), F.col("copies").alias(copies)),
        "taken",
    )
    found = join_groups(keyed, taken, [key], same)
    one = found.where(F.col(same) > 1).dropDuplicates([key])
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))
    return found.where(F.col(same) == 1).unionByName(one).withColumn(copy, again).select(*docs.columns)


def repeat_documents(docs: DataFrame, mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as ``mix`` (id, copies) says. Ids must be unique and not null."""
    name, times, copy = unused_names(docs, "_id", "_copies", "_copy")
    copies = mix.where("copies > 0").select(F.col("id").alias(name), F.col("copies").alias(times))
    taken = docs.join(copies, docs[key] == F.col(name))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    return taken.withColumn(copy, again).select(*docs.columns)
