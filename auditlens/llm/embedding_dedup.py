"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Rows of one label are dealt into blocks of about ``BLOCK`` rows; a task multiplies two blocks as int8
vectors. A unit vector x is held as s*q + e with the exact norm of e, so |x.y - s*t*(q.r)| is at most
|s*q||f| + |t*r||e| + |e||f| for any pair (Cauchy-Schwarz). Only pairs that may reach the threshold
within that bound are recomputed from the full vectors in double precision.

A tile writes a count and the smallest linked row for each of its rows, never its pairs. Vectors equal
in every component are one class from the start, with a weight.

* vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label,
  are linked with nothing, as are rows without id; vectors of different lengths are never compared
* a cosine within rounding of the threshold is decided by the double-precision dot product
* an empty table gives an empty result; other columns are never read
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import connected_components, join_groups

BLOCK = 1024
THRESHOLD = 0.93
# Added to every bound: more than the rounding of the norms and products behind it.
SLACK = 1e-9


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, norms of the coded vectors, and norms of the errors, of unit vectors."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(vectors - coded, axis=1)


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose cosine reaches the threshold; the rows are unit vectors in double precision."""
    q, s, qn, qe = quantise(left)
    r, t, rn, re = quantise(right)
    # Products of int8 sums stay below 2**24 up to 1,040 dimensions, so single precision is exact there.
    kind = np.float32 if left.shape[1] <= 1040 else np.float64
    product = (q.astype(kind) @ r.astype(kind).T).astype(np.float64) * s[:, None] * t[None, :]
    bound = qn[:, None] * re[None, :] + qe[:, None] * rn[None, :] + qe[:, None] * re[None, :] + SLACK
    i, j = np.nonzero(product + bound >= threshold)
    hit = np.zeros(len(i), dtype=bool)
    for start in range(0, len(i), 100_000):
        part = slice(start, start + 100_000)
        hit[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= threshold
    return i[hit], j[hit]


def _tile(threshold: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        one, other = int(tile["one"].iloc[0]), int(tile["other"].iloc[0])
        ids, weights = tile["id"].to_numpy(), tile["weight"].to_numpy()
        rows = np.stack(tile["vector"].to_numpy()).astype(np.float64)
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        blocks = tile["block"].to_numpy()
        a, b = np.flatnonzero(blocks == one), np.flatnonzero(blocks == other)
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        i, j = linked_pairs(rows[a], rows[b], threshold)
        i, j = a[i], b[j]
        if one == other:
            i, j = i[i < j], j[i < j]
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, i, weights[j])
        np.add.at(links, j, weights[i])
        root = np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        root = rank.copy()
        while True:  # smallest rank reachable inside the tile
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            root = np.minimum(root, root[order[root]])
            if (root == before).all():
                break
        seen = links > 0
        return pd.DataFrame({"id": ids[seen], "links": links[seen], "root": ids[order[root[seen]]]})

    return run


def near_vectors(
    rows: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component) for every row."""
    read = rows.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    largest = F.array_max(F.transform("vector", F.abs))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & (largest > 0), F.lit(False))
    # Scaled by a power of two, which is exact, so that squares neither overflow nor vanish; -0.0 becomes 0.0.
    power = F.pow(F.lit(2.0), -F.floor(F.log2(F.col("largest"))).cast("double"))
    scaled = F.transform("vector", lambda x: x * F.col("power") + F.lit(0.0))
    valid = (
        read.where(usable)
        .withColumn("largest", largest)
        .withColumn("power", power)
        .select("id", "label", F.size("vector").alias("length"), scaled.alias("vector"))
        .withColumn("digest", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary")))
    )
    valid = stored(valid, "vectors")
    same = ["label", "length", "digest"]
    classes = stored(
        valid.groupBy(*same).agg(
            F.min("id").alias("class"), F.count("*").alias("weight"), F.min_by("vector", "id").alias("vector")
        ),
        "classes",
    )
    sizes = classes.groupBy("label", "length").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "length"]).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(41), "class"), F.col("blocks")).cast("int")
    )
    tiles = dealt.select(
        "label",
        "length",
        F.col("class").alias("id"),
        "weight",
        "vector",
        "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner"),
    ).withColumns({"one": F.least("block", "partner"), "other": F.greatest("block", "partner")})
    found = stored(
        tiles.groupBy("label", "length", "one", "other").applyInPandas(
            _tile(threshold), "id long, links long, root long"
        ),
        "tile-links",
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    settled = (
        classes.drop("vector")
        .join(counts, F.col("class") == F.col("id"), "left")
        .drop("id")
        .join(parts, F.col("class") == F.col("node"), "left")
        .select(
            *same,
            "weight",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("component"),
        )
    )
    settled = stored(settled, "class-components")
    linked = join_groups(valid.drop("vector"), settled, same, "weight").select("id", "n_links", "component")
    others = read.where(~usable).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component")
    )
    return linked.unionByName(others)
