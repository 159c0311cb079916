"""Near-duplicates by MinHash with an inverted join over signature coordinates.

Every distinct shingle set gets a signature of ``COORDINATES`` minima. Sets are posted under each
(coordinate, value); two sets are candidates when they meet under at least ``MATCHES`` coordinates
(at a similarity of 0.75 fewer have a chance of 3e-6). Candidates are confirmed on their full sets.

* Prefix and skip: values held by one set only are never merged. Of a set's remaining s postings,
  rarest first, only the first s - MATCHES + 1 generate candidates: sets with enough in common meet
  there. The long lists behind them are skipped and only counted for pairs already met.
* No all-pairs output: in rounds, every set is compared with one other, a member of the largest component
  in its lists, which joins a group of thousands of copies by about as many links. Only what these
  rounds leave in different components then meets pair by pair. The collision count, on 8-bit codes of the
  values and so never too small, is part of that meeting; long lists are compared block by block together
  with their full sets, and write confirmed links alone. The rounds save work; the pairs decide.
* Exact copies, and any sets equal as a whole, are one class from the start.

Documents without words are linked with nothing; fewer words than a shingle are one shingle; null text
is empty; rows without id are linked with nothing. Rows that repeat an id share a component. An empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import connected_components, join_groups, unused_names
from .words import SHINGLE, WordIds, shingles, word_ids

COORDINATES = 63
MATCHES = 31
PERCENT = 75
LONG_LIST = 16
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 19
_COLUMNS = 4096
# Rounds of one partner per set; they end when fewer than one in FRUITLESS of the partners links.
ROUNDS = 8
FRUITLESS = 20
_CHUNK = 2048
# Codes per number, bits per code with its spare top bit, and the mask of the spare bits.
_PER_NUMBER = 7
_FIELD = 9
_SPARE = sum(1 << (_FIELD * i + _FIELD - 1) for i in range(_PER_NUMBER))
# The coordinate takes the low bits of a posted value.
_LOW = np.uint64(63)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240601)
    a = random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest permuted hash, with the coordinate in its low bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK, None] * a + b
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0), out=low)
    return ((low & ~_LOW) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def codes(values: np.ndarray) -> np.ndarray:
    """Eight bits of every value, seven values to a number."""
    fields = ((values.view(np.uint64) >> np.uint64(6)) & np.uint64(255)).reshape(-1, _PER_NUMBER)
    shifts = np.arange(_PER_NUMBER, dtype=np.uint64) * np.uint64(_FIELD)
    return (fields << shifts).sum(axis=1).view(np.int64)


def code_matches(one: str, other: str) -> Column:
    """In how many codes two rows agree: a field of spare - (a xor b) keeps its top bit only where a = b."""
    total = F.lit(0)
    for k in range(COORDINATES // _PER_NUMBER):
        differs = F.get(F.col(one), F.lit(k)).bitwiseXOR(F.get(F.col(other), F.lit(k)))
        total = total + F.bit_count((F.lit(_SPARE) - differs).bitwiseAND(F.lit(_SPARE)))
    return total


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, n, set1, set2, signature, codes): size and 128-bit digest of the set; signature and codes, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (a, b) = WordIds(), _multipliers()
        for batch in batches:
            sizes, digests, found = [], [], []
            for value in batch.column(1):
                hashes = shingles(word_ids(value.as_py(), ids), width)
                sizes.append(len(hashes))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64))
                found.append(signature(hashes, a, b) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array([None if f is None else codes(f) for f in found], pa.list_(pa.int64())),
                ],
                names=["id", "n", "set1", "set2", "signature", "codes"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, set1 long, set2 long, signature array<long>, codes array<long>")


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(id, shingles) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            sets = [shingles(word_ids(v.as_py(), ids), width).view(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "id long, shingles array<long>"
    )


def _sizes_allow(n: Column, other: Column) -> Column:
    return F.least(n, other) * 100 >= F.greatest(n, other) * PERCENT


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return pairs.join(first, "a").join(second, "b").where(common * 100 >= union * PERCENT).select("a", "b")


def _labelled(early: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, n, value, part): postings with the component found so far, the id itself where there is none."""
    return early.join(parts, F.col("id") == F.col("node"), "left").select(
        "id", "n", "value", F.coalesce("component", "id").alias("part")
    )


def _one_partner(labelled: DataFrame, number: int) -> DataFrame:
    """(a, b): for every set outside the largest part of its lists one member of such a part.

    Each list names a member of its largest part, another one each round; a set takes the member that
    most of its lists name.
    """
    place = F.xxhash64(F.lit(91 + number), "id")
    members = labelled.groupBy("value", "part").agg(
        F.count("*").alias("size"), F.min_by(F.struct("id", "n"), place).alias("named")
    )
    lists = (
        members.groupBy("value")
        .agg(
            F.count("*").alias("parts"),
            F.max_by(F.struct("part", "named"), F.struct("size", -F.col("part"))).alias("top"),
        )
        .where("parts > 1")
        .select("value", F.col("top.part").alias("top"), "top.named")
    )
    votes = (
        labelled.join(lists, "value")
        .where((F.col("part") != F.col("top")) & _sizes_allow(F.col("n"), F.col("named.n")))
        .groupBy("id", F.col("named.id").alias("other"))
        .agg(F.count("*").alias("votes"))
    )
    return votes.groupBy("id").agg(F.max_by("other", F.struct("votes", -F.col("other"))).alias("b")).select(
        F.col("id").alias("a"), "b"
    )


def links_between_parts(
    lists: DataFrame, sets: DataFrame, long_list: int = LONG_LIST, rows: int = BLOCK_ROWS, shingled: int = BLOCK_SHINGLES
) -> DataFrame:
    """Distinct links (a, b) between sets of different parts that meet in a list of (value, id, n, part, codes)
    and agree in at least ``MATCHES`` codes; ``sets`` has (id, shingles).

    Short lists are joined with themselves, and the pairs confirmed on the sets. A long list is dealt into blocks
    of bounded rows and shingles; a task takes two of them with their sets and writes the links alone, so that
    a crowd of sets just below the threshold costs arithmetic, not rows.
    """
    sizes = lists.groupBy("value").agg(F.count("*").alias("length"), F.sum("n").alias("shingled"))
    short = lists.join(sizes.where(F.col("length") <= long_list).select("value"), "value", "left_semi")
    columns = ("id", "n", "part", "codes")
    left = short.select("value", *[F.col(c).alias(f"{c}1") for c in columns]).alias("left")
    right = short.select("value", *[F.col(c).alias(f"{c}2") for c in columns]).alias("right")
    meeting = (
        (F.col("left.value") == F.col("right.value"))
        & (F.col("id1") < F.col("id2"))
        & (F.col("part1") != F.col("part2"))
        & _sizes_allow(F.col("n1"), F.col("n2"))
        & (code_matches("codes1", "codes2") >= MATCHES)
    )
    pairs = left.join(right, meeting).select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()
    wanted = F.ceil(F.greatest(F.col("length") / rows, F.col("shingled") / shingled)).cast("int")
    blocks = sizes.where(F.col("length") > long_list).select("value", wanted.alias("blocks"))
    dealt = lists.join(blocks, "value").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(81), "id"), F.col("blocks")).cast("int")
    )
    tiles = (
        dealt.join(sets, "id")
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"one": F.least("block", "partner"), "other": F.greatest("block", "partner")})
        .select("value", "one", "other", "block", *columns, "shingles")
    )
    compared = tiles.groupBy("value", "one", "other").applyInPandas(_compare, "a long, b long")
    return confirmed(pairs, sets).unionByName(compared).distinct()


def _compare(tile: pd.DataFrame) -> pd.DataFrame:
    """The links between two blocks of a list, or inside one."""
    block = tile["block"].to_numpy()
    numbers = np.stack(tile["codes"].to_numpy())
    shifts = np.arange(_PER_NUMBER, dtype=np.int64) * _FIELD
    fields = ((numbers[:, :, None] >> shifts) & 255).astype(np.uint8).reshape(len(tile), -1)
    ids, sizes, parts = (tile[c].to_numpy() for c in ("id", "n", "part"))
    first, second = np.flatnonzero(block == tile["one"].iloc[0]), np.flatnonzero(block == tile["other"].iloc[0])
    may = np.zeros((len(first), len(second)), dtype=bool)
    for start in range(0, len(first), 64):
        rows = first[start : start + 64]
        same = (fields[rows][:, None, :] == fields[second][None, :, :]).sum(axis=2)
        may[start : start + 64] = (same >= MATCHES) & (parts[rows][:, None] != parts[second][None, :])
    small, large = (f(sizes[first][:, None], sizes[second][None, :]) for f in (np.minimum, np.maximum))
    may &= small * 100 >= large * PERCENT
    if not may.any():
        return pd.DataFrame({"a": [], "b": []})
    first, second, may = first[may.any(axis=1)], second[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    sets = tile["shingles"].to_numpy()
    common = _common(sets[first], sets[second])
    union = sizes[first][:, None] + sizes[second][None, :] - common
    i, j = np.nonzero(may & (common * 100 >= union * PERCENT))
    pairs = np.stack([ids[first[i]], ids[second[j]]], axis=1)
    return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of their incidence matrices, some columns at a time."""
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        held = shared[at] == values if len(shared) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((rows[held][order], at[held][order]))
    for start in range(0, len(shared), _COLUMNS):
        matrices = []
        for sets, (rows, at) in zip((left, right), sides, strict=True):
            low, high = np.searchsorted(at, [start, start + _COLUMNS])
            matrix = np.zeros((len(sets), min(_COLUMNS, len(shared) - start)), dtype=np.float32)
            matrix[rows[low:high], at[low:high] - start] = 1
            matrices.append(matrix)
        common += np.rint(matrices[0] @ matrices[1].T).astype(np.int64)
    return common


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component) for every row; ``component`` is the smallest id reachable by links."""
    signed = stored(signatures(docs, key, text, width), "signatures")
    same = ["n", "set1", "set2"]
    filled = signed.where("n > 0 and id is not null")
    classes = stored(
        filled.groupBy(*same)
        .agg(
            F.min("id").alias("class"),
            F.count("*").alias("rows"),
            F.min_by(F.struct("signature", "codes"), "id").alias("held"),
        )
        .select(*same, "class", "rows", "held.signature", "held.codes"),
        "classes",
    )
    postings = classes.select(F.col("class").alias("id"), "n", F.explode("signature").alias("value"))
    met = postings.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    shared = postings.join(met, "value")
    by_rarity = Window.partitionBy("id").orderBy("length", "value")
    whole = Window.partitionBy("id")
    early = stored(
        shared.withColumns({"meets": F.count("*").over(whole), "rank": F.row_number().over(by_rarity)})
        .where(F.col("rank") <= F.col("meets") - MATCHES + 1)
        .select("id", "n", "value"),
        "early-postings",
    )
    eligible = early.select("id").distinct()
    texts = docs.select(F.col(key).cast("bigint").alias("id"), text).withColumnRenamed(text, "text")
    sets = stored(
        shingle_sets(texts.join(eligible, "id", "left_semi").dropDuplicates(["id"]), width), "sets"
    )

    links = stored(sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "links")
    parts = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for number in range(ROUNDS):
        tried = stored(_one_partner(_labelled(early, parts), number), "partners")
        fresh = stored(confirmed(tried.select("a", "b"), sets), "links")
        links = stored(links.unionByName(fresh), "links")
        parts = stored(connected_components(links), "components")
        if fresh.count() * FRUITLESS < tried.count():
            break

    # What is left: lists whose sets are in different components.
    labelled = _labelled(early, parts)
    mixed = labelled.groupBy("value").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    open_lists = stored(
        labelled.join(mixed.select("value"), "value", "left_semi").join(
            classes.select(F.col("class").alias("id"), "codes"), "id"
        ),
        "open-lists",
    )
    links = links.unionByName(links_between_parts(open_lists, sets))
    components = connected_components(links)

    linked = classes.join(components, F.col("class") == F.col("node"), "left").select(
        *same, "rows", F.coalesce("component", "class").alias("component")
    )
    single = signed.where("n = 0 or id is null").select(
        "id", F.col("n").alias("n_shingles"), F.col("id").alias("component")
    )
    return (
        join_groups(filled.select("id", *same), stored(linked, "class-components"), same, "rows")
        .select("id", F.col("n").alias("n_shingles"), "component")
        .unionByName(single)
    )


def _keep_one_of_each_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`keep_one_of_each` where ids repeat with other texts: distinct (id, text) are numbered in id order."""
    digest = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    named = stored(docs.select(docs[key].alias("id"), digest.alias("digest"), docs[text].alias("text")), "texts")
    # Sorted into ranges, so that numbers rise with ids; stored, so that they are drawn once.
    numbers = stored(
        named.where("id is not null")
        .select("id", "digest")
        .distinct()
        .orderBy("id", "digest")
        .withColumn("number", F.monotonically_increasing_id()),
        "numbers",
    )
    found = near_duplicates(named.join(numbers, ["id", "digest"]).dropDuplicates(["number"]), "number", "text")
    of_component = numbers.select(F.col("number").alias("component"), F.col("id").alias("kept"))
    own_id, own_digest = unused_names(docs, "_id", "_digest")
    dropped = (
        found.where("id <> component")
        .withColumnRenamed("id", "number")
        .join(of_component, "component")
        .join(numbers, "number")
        .where("id <> kept")
        .select(F.col("id").alias(own_id), F.col("digest").alias(own_digest))
    )
    return docs.join(dropped, (docs[key] == F.col(own_id)) & (digest == F.col(own_digest)), "left_anti")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id.

    If an id occurs with several texts, every (id, text) is a document of its own.
    """
    body = F.coalesce(docs[text], F.lit(""))
    hashes = docs.select(docs[key].alias("id"), F.xxhash64(body).alias("h")).where("id is not null")
    if not hashes.groupBy("id").agg(F.min("h").alias("h1"), F.max("h").alias("h2")).where("h1 <> h2").isEmpty():
        return _keep_one_of_each_text(docs, key, text)
    (name,) = unused_names(docs, "_id")
    dropped = near_duplicates(docs, key, text).where("id <> component").select(F.col("id").alias(name)).distinct()
    return docs.join(dropped, docs[key] == F.col(name), "left_anti")
