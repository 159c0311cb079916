"""Shards of near-equal bytes by a k-d tree over document metadata.

The points are groups of equal texts. A node with k shards to fill is cut along its widest dimension
where floor(k/2)/k of its bytes lie before: a weighted median, found for all nodes of a level at once
with a few rounds of histograms over (node, bin), each combined before its shuffle. The driver sees
one bin per node, never rows, groups or texts.

Dimensions: bytes (logarithmic), source and language (hashed), all of the group's smallest values, so
copies of a text have one place and stay together. A group of more than ``heavy`` of a shard's bytes
cannot: its rows are spread by a hash of their id so that a cut can pass through them.

* size is the UTF-8 bytes of the text (null: none) plus a fixed charge per row
* null sources and languages are values of their own; null and empty texts are one group
* with fewer rows than shards some shards stay empty; an empty table gives an empty result
* other columns are never read
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import crc32_of, join_groups, n_bytes, numbered

ROW_CHARGE = 16
BINS = 4096
ROUNDS = 5
GRID = 1 << 10
DIMENSIONS = ("x0", "x1", "x2")


def _unit(seed: int, *columns: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 32)) / F.lit(float(1 << 32))


def metadata(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, text_key, source, lang) of every row: all that sharding needs of a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("id"),
        (n_bytes(F.col(text)) + ROW_CHARGE).alias("size"),
        crc32_of(F.col(text)).alias("text_crc32"),
        F.xxhash64(body).alias("text_key"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )


def place(rows: DataFrame, heavy_bytes: float) -> DataFrame:
    """Add the coordinates x0, x1, x2 to the rows of :func:`metadata`.

    A coordinate is a value on a grid plus a fraction of the grid's step that is equal for equal texts.
    """
    groups = rows.groupBy("text_key", "text_crc32").agg(
        F.count("*").alias("group_rows"),
        F.sum("size").alias("group_bytes"),
        F.min(F.coalesce("source", F.lit("￿"))).alias("group_source"),
        F.min(F.coalesce("lang", F.lit("￿"))).alias("group_lang"),
    )
    both = join_groups(rows, groups, ["text_key", "text_crc32"], "group_rows")
    jitter = F.when(F.col("group_bytes") > heavy_bytes, _unit(31, F.col("id"))).otherwise(
        _unit(32, F.col("text_key"), F.col("text_crc32"))
    )
    values = (F.log2(F.col("size")) / 64, _unit(33, F.col("group_source")), _unit(34, F.col("group_lang")))
    spots = {x: (F.floor(v * GRID) + F.col("jitter")) / GRID for x, v in zip(DIMENSIONS, values, strict=True)}
    return both.withColumn("jitter", jitter).withColumns(spots).select("id", "size", "text_crc32", *DIMENSIONS)


def _at() -> Column:
    """The coordinate along the node's chosen dimension."""
    return F.get(F.array(*[F.col(x) for x in DIMENSIONS]), F.col("dim"))


def _widest(rows: DataFrame) -> list[dict]:
    """For each open node its widest dimension, the interval it spans, and the bytes to lie before the cut."""
    spans = rows.where("shards > 1").groupBy("first", "shards").agg(
        F.sum("size").alias("bytes"),
        *[F.min(x).alias(f"low_{x}") for x in DIMENSIONS],
        *[F.max(x).alias(f"high_{x}") for x in DIMENSIONS],
    )
    cuts = []
    for span in spans.collect():
        widths = [span[f"high_{x}"] - span[f"low_{x}"] for x in DIMENSIONS]
        dim = widths.index(max(widths))
        cuts.append(
            {
                "first": span["first"],
                "shards": span["shards"],
                "dim": dim,
                "low": span[f"low_{DIMENSIONS[dim]}"],
                # Just above the largest value, so that every row lies below ``high``.
                "high": span[f"high_{DIMENSIONS[dim]}"] + 2.0**-50,
                "before": 0,
                "goal": span["bytes"] * (span["shards"] // 2) / span["shards"],
            }
        )
    return cuts


_NODE = [("first", pa.int32()), ("shards", pa.int32()), ("dim", pa.int32())]
CHOSEN = pa.schema([*_NODE, ("cut", pa.float64())])
CUT = pa.schema(
    [*_NODE, ("low", pa.float64()), ("high", pa.float64()), ("before", pa.int64()), ("goal", pa.float64())]
)


def _table(rows: DataFrame, cuts: list[dict], schema: pa.Schema) -> DataFrame:
    """Cuts as a local relation, whose size the planner knows."""
    columns = [{name: cut[name] for name in schema.names} for cut in cuts]
    return rows.sparkSession.createDataFrame(pa.Table.from_pylist(columns, schema))


def _narrow(rows: DataFrame, cuts: list[dict]) -> list[dict]:
    """The bin of each node that holds the goal becomes its new interval; ``before`` counts what lies below."""
    table = _table(rows, cuts, CUT)
    at = _at()
    step = (F.col("high") - F.col("low")) / BINS
    inside = rows.join(table, ["first", "shards"]).where((at >= F.col("low")) & (at < F.col("high")))
    place = F.least(F.floor((at - F.col("low")) / step), F.lit(BINS - 1)).cast("int")
    counts = inside.groupBy(*CUT.names, place.alias("bin")).agg(
        F.sum("size").alias("bytes"), (F.min(at) == F.max(at)).alias("one_place")
    )
    upto = F.col("before") + F.sum("bytes").over(Window.partitionBy("first", "shards").orderBy("bin"))
    hits = counts.withColumn("upto", upto).where(
        (F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("bytes") < F.col("goal"))
    )
    narrowed = []
    for hit in hits.collect():
        width = (hit["high"] - hit["low"]) / BINS
        low = hit["low"] + hit["bin"] * width
        high = hit["high"] if hit["bin"] == BINS - 1 else low + width
        narrowed.append(
            {k: hit[k] for k in ("first", "shards", "dim", "goal", "bytes", "one_place")}
            | {"low": low, "high": high, "before": hit["upto"] - hit["bytes"]}
        )
    return narrowed


def kd_shards(rows: DataFrame, n_shards: int, tolerance: float = 0.001) -> DataFrame:
    """Add ``shard`` (0 .. n_shards - 1) to rows with size and coordinates.

    A node's interval is narrowed until it holds one place or less than ``tolerance`` of a shard, at
    most ``ROUNDS`` times, by when the bins are finer than the coordinates; the nearer end is the cut.
    The driver holds the tree: one cut for every shard but one.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    enough = tolerance * total / n_shards
    level = rows.withColumns({"first": F.lit(0), "shards": F.lit(int(n_shards))})
    largest = n_shards if total else 1
    while largest > 1:
        if largest < n_shards:
            level = stored(level, "level")
        done, cuts = [], _widest(level)
        for left in reversed(range(ROUNDS)):
            cuts = _narrow(level, cuts)
            settled = [c for c in cuts if not left or c["one_place"] or c["bytes"] <= enough]
            done += settled
            cuts = [c for c in cuts if c not in settled]
            if not cuts:
                break
        for c in done:
            past, short = c["before"] + c["bytes"] - c["goal"], c["goal"] - c["before"]
            c["cut"] = c["high"] if past < short else c["low"]
        table = _table(rows, done, CHOSEN)
        half = F.floor(F.col("shards") / 2).cast("int")
        goes_left = _at() < F.col("cut")
        cut = level.join(table, ["first", "shards"], "left")
        level = cut.select(
            "id",
            "size",
            "text_crc32",
            *DIMENSIONS,
            F.when(F.col("shards") <= 1, F.col("first"))
            .when(goes_left, F.col("first"))
            .otherwise(F.col("first") + half)
            .cast("int")
            .alias("first"),
            F.when(F.col("shards") <= 1, F.col("shards"))
            .when(goes_left, half)
            .otherwise(F.col("shards") - half)
            .cast("int")
            .alias("shards"),
        )
        largest = largest - largest // 2
    return level.select("id", "size", "text_crc32", F.col("first").alias("shard"))


def shard_documents(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    heavy: float = 0.05,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slots run from 0 without gaps inside a shard.

    Give the number of shards, or the bytes a shard should reach.
    """
    rows = stored(metadata(docs, key, text), "metadata")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    placed = stored(place(rows, heavy * total / n_shards), "placed")
    return numbered(stored(kd_shards(placed, n_shards), "shards"), ["shard"], "id", "slot")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, in slot order; ids must be unique and not null."""
    where = shards.select(F.col("id").alias("_id"), "shard", "slot")
    rows = docs.join(where, docs[key] == F.col("_id")).drop("_id")
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
