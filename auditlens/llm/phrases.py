"""Phrase collocation mining with broadcast double-array tries.

A phrase can only be frequent if all its parts are. So the texts are mined length by length, and after each
length they are trimmed to the stretches whose every part of that length is frequent, which keeps them short.
For a length there are three passes over what is left of the texts:

1. every candidate occurrence is hashed into one of ``BUCKETS`` buckets, and the buckets whose count reaches
   ``least`` become a bit map of fixed size: a phrase in any other bucket cannot be frequent (on more text more
   buckets are full, and more candidates are counted);
2. the distinct phrases in those buckets are the candidates;
3. where ``TRIES_AT_ONCE`` tries hold them all, these are broadcast, each task advances all positions of its texts
   through the trie of their shard symbol by symbol, counts the accepting states, and the counts of all tasks are summed.

Where more tries are needed, step 2 and 3 are one pass still: the occurrences in those buckets are dealt by their words,
equal ones of a block of text together, and each task builds the tries of its candidates and advances what it was dealt
through them. So the passes over the texts do not grow with the candidates, and nothing of their number is broadcast.
Trimming looks up 64-bit numbers of the frequent phrases: should two phrases
share one, a stretch too many is kept and nothing is counted wrongly. Broadcasts and stored copies go as soon as the
next step is stored, so that disk and memory do not grow with the passes. Words are 64-bit numbers, different per language; a collision among all words of the corpus is looked for, and the
numbers drawn anew if there is one. Scores are exact: decimals of 38 digits.

* a null text counts as empty, a null language as ``und``; A-Z count as a-z, other letters as they stand
* pieces and words of any length are taken whole; repeated rows count as often as they occur
* ties of score and count go to the smaller phrase in byte order; an empty table gives an empty result
* the columns read are renamed first, so that others may have any name
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stored
from .tries import MOST_WORDS, PhraseTrie, run_starts
from .words import mix64

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_NORMAL = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")

BUCKET_BITS = 26
BUCKETS = 1 << BUCKET_BITS
# Words or phrases of one broadcast set, phrases of one trie, tries broadcast together.
WORDS_AT_ONCE = 4_000_000
PHRASES_PER_TRIE = 300_000
TRIES_AT_ONCE = 1

_ROW = 1 << 13
_ROWS_AT_ONCE = 16
# Bytes of the texts that are counted, or encoded, together.
_COUNTED_BYTES = 4 << 20
_ENCODED_BYTES = 1 << 20
_COUNTED_TOGETHER = 2_000_000
# Occurrences that a task is dealt at most, equal ones of a block of text counting once.
_DEALT_TOGETHER = 1_500_000
# Buckets of a slice, and what one slice can count at most.
_SLICE = 1 << 16
_MOST = (1 << 16) - 1
_NO_WORD = 1
_POSITIONS = np.random.default_rng(77).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


@dataclass
class Mined:
    """``totals`` (lang, n); ``words`` (id, lang, word, f); ``phrases`` (w: word ids, f) of two words or more."""

    totals: DataFrame
    words: DataFrame
    phrases: DataFrame


def _encoded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of some texts, and the place of every word among them in order: ``\\n`` stands between pieces
    and texts, empty ones where blanks meet."""
    joined = b"\n".join(texts).lower().translate(_NORMAL).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([joined], pa.large_binary()), pattern=b" ").values.dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy()


def _by_language(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[dict[str, list[bytes]]]:
    """Texts per language, about ``together`` bytes at a time; longer texts whole."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, []).append(text := text.as_py())
            size += len(text) + 1
            if size >= together:
                yield held
                held, size = {}, 0
    if held:
        yield held
    held = {}
    # Else the worker keeps what Arrow needed here through the passes that follow.
    pa.default_memory_pool().release_unused()


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )


def _seed(lang: str, salt: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), salt)


def _word_id(word: bytes, seed: int) -> int:
    """0 separates pieces and 1 stands for no word: neither is a word's number."""
    return max(xxhash.xxh3_64_intdigest(word, seed), 2)


def word_counts(rows: DataFrame, salt: int) -> DataFrame:
    """(id, lang, word, n): all words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_language(batches, _COUNTED_BYTES):
            for lang, texts in held.items():
                words, at = _encoded(texts)
                counts = np.bincount(at, minlength=len(words))
                seed = _seed(lang, salt)
                kept = np.array([w not in (b"", b"\n") for w in words], bool)
                words = [w for w in words if w not in (b"", b"\n")]
                ids = np.fromiter((_word_id(w, seed) for w in words), np.uint64, len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.view(np.int64)),
                        pa.array([lang] * len(words), pa.string()),
                        pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                        pa.array(counts[kept], pa.int64()),
                    ],
                    ["id", "lang", "word", "n"],
                )

    found = rows.mapInArrow(run, "id long, lang string, word string, n long")
    return found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def _text_ids(rows: Iterator[pa.RecordBatch], salt: int) -> Iterator[np.ndarray]:
    """Texts as word numbers, 0 between pieces; short texts together, long ones whole."""
    for held in _by_language(rows, _ENCODED_BYTES):
        parts: list[np.ndarray] = []
        for lang, texts in held.items():
            words, at = _encoded(texts)
            seed = _seed(lang, salt)
            ids = np.fromiter((_word_id(w, seed) for w in words), np.uint64, len(words))
            for word, number in ((b"", _NO_WORD), (b"\n", 0)):
                if word in words:
                    ids[words.index(word)] = number
            numbers = ids[at]
            parts += [numbers[numbers != _NO_WORD], np.zeros(1, np.uint64)]
        yield np.concatenate(parts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(word numbers, marks if any) of a table of trimmed texts, several rows at a time; every row ends a piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
            part = batch.slice(start, _ROWS_AT_ONCE)
            # Marks are on all rows of a table or on none.
            ids = b"".join(part.column(0).to_pylist())
            marked = part.column(1).null_count == 0
            yield np.frombuffer(ids, np.uint64), np.frombuffer(b"".join(part.column(1).to_pylist()), bool) if marked else None
    batch = part = None
    # As in :func:`_by_language`.
    pa.default_memory_pool().release_unused()


_BLOCK_SCHEMA = "ids binary, mark binary"


def _block(ids: np.ndarray, mark: np.ndarray | None) -> pa.RecordBatch:
    """Rows of about ``_ROW`` words, cut between pieces: a file writer buffers at least a hundred rows."""
    breaks = np.flatnonzero(ids == 0)
    after = np.searchsorted(breaks, np.arange(_ROW, len(ids), _ROW))
    cuts = np.unique(breaks[after[after < len(breaks)]] + 1)
    marks = [None] * (len(cuts) + 1) if mark is None else [m.tobytes() for m in np.split(mark, cuts)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part.tobytes() for part in np.split(ids, cuts)], pa.binary()), pa.array(marks, pa.binary())],
        ["ids", "mark"],
    )


def trimmed(ids: np.ndarray, mark: np.ndarray, length: int) -> np.ndarray:
    """What can hold a frequent phrase of ``length + 1`` words, where ``mark`` tells at which positions a frequent
    one of ``length`` starts: every run of two marks or more with all words of its phrases, 0 after each."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    starts, ends = edges[0::2], edges[1::2]
    long = ends - starts >= 2
    starts, sizes = starts[long], ends[long] - starts[long] + length - 1
    if not len(starts):
        return ids[:0]
    before = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.zeros(int(sizes.sum()) + len(sizes), ids.dtype)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(before, sizes) + inside] = ids[np.repeat(starts, sizes) + inside]
    return out


def _safe_starts(ids: np.ndarray, length: int) -> np.ndarray:
    """Positions where ``length`` words follow without a break: in trimmed texts, those with frequent parts only."""
    word = ids != 0
    starts = word[: max(len(ids) - length + 1, 0)].copy()
    for k in range(1, length):
        starts &= word[k : len(ids) - length + 1 + k]
    return np.flatnonzero(starts)


def _phrase_hash(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for k in range(length):
        total += mix64(ids[at + k] * _POSITIONS[k])
    return mix64(total)


def _columns(length: int) -> list[str]:
    return [f"w{k}" for k in range(length)]


def _bucket_bits(blocks: DataFrame, length: int, least: int) -> tuple[np.ndarray, int]:
    """A bit per bucket: set where candidate occurrences of ``length`` words reach ``least``, ``BUCKETS`` / 8 bytes; and
    how many occurrences at least lie in these buckets.

    Counts travel as the filled buckets of each slice of the buckets, at most ``_MOST`` counted per task and bucket,
    and are added up slice by slice as they arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for ids, _ in _blocks(batches):
            parts.append((_phrase_hash(ids, _safe_starts(ids, length), length) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            held += len(parts[-1])
            if held >= _COUNTED_TOGETHER:
                yield _slices(np.concatenate(parts))
                parts, held = [], 0
        if held:
            yield _slices(np.concatenate(parts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, at, n in zip(*batch.columns):
                total = totals.setdefault(number.as_py(), np.zeros(_SLICE, np.uint16))
                at, n = np.frombuffer(at.as_py(), np.uint16), np.frombuffer(n.as_py(), np.uint16)
                total[at] = np.minimum(total[at].astype(np.uint32) + n, _MOST)
        filled = [t >= min(least, _MOST) for t in totals.values()]
        inside = [int(t[f].sum(dtype=np.int64)) for t, f in zip(totals.values(), filled)]
        bits = [np.packbits(f, bitorder="little").tobytes() for f in filled]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(bits, pa.binary()), pa.array(inside, pa.int64())], ["slice", "bits", "n"]
        )

    counts = blocks.mapInArrow(run, "slice int, at binary, n binary")
    bits, inside = np.zeros(BUCKETS >> 3, np.uint8), 0
    for row in counts.repartition("slice").mapInArrow(add, "slice int, bits binary, n long").collect():
        bits[row.slice * _SLICE >> 3 : (row.slice + 1) * _SLICE >> 3] = np.frombuffer(row.bits, np.uint8)
        inside += row.n
    return bits, inside


def _slices(buckets: np.ndarray) -> pa.RecordBatch:
    """The filled buckets of every slice with their counts."""
    filled, n = np.unique(buckets, return_counts=True)
    slices = filled // _SLICE
    firsts = np.flatnonzero(np.diff(slices, prepend=-1))
    at, n = (filled % _SLICE).astype(np.uint16), np.minimum(n, _MOST).astype(np.uint16)
    ends = np.append(firsts[1:], len(filled))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(slices[firsts], pa.int32()),
            pa.array([at[i:j].tobytes() for i, j in zip(firsts, ends)], pa.binary()),
            pa.array([n[i:j].tobytes() for i, j in zip(firsts, ends)], pa.binary()),
        ],
        ["slice", "at", "n"],
    )


def _occurrences(blocks: DataFrame, length: int, bits: Broadcast) -> DataFrame:
    """(w0, w1, ..., n): the phrases of ``length`` words in the buckets whose bit is set, once per block of text."""
    columns = _columns(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bits.value
        for ids, _ in _blocks(batches):
            at = _safe_starts(ids, length)
            number = _phrase_hash(ids, at, length)
            bucket = (number >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            inside = (kept[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
            # Equal phrases meet when sorted by their numbers; what two phrases of one number leave goes with the rest.
            at = at[inside][np.argsort(number[inside])]
            words = [ids[at + k] for k in range(length)]
            new = run_starts(*words)
            n = np.diff(np.append(new, len(at)))
            yield pa.RecordBatch.from_arrays([*(pa.array(w[new].view(np.int64)) for w in words), pa.array(n, pa.int64())], [*columns, "n"])

    return blocks.mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", n long")


def _frequent(blocks: DataFrame, length: int, least: int) -> DataFrame | None:
    """(w0, w1, ..., f): the phrases of ``length`` words that occur ``least`` times, stored; None without a candidate."""
    found, inside = _bucket_bits(blocks, length, least)
    bits = blocks.sparkSession.sparkContext.broadcast(found)
    occurrences = _occurrences(blocks, length, bits)
    if _shards(inside, length) > TRIES_AT_ONCE:
        frequent = stored(_dealt(occurrences, -(-inside // _DEALT_TOGETHER), length, least), f"phrases-{length}")
        bits.destroy()
        return frequent
    candidates = stored(occurrences.select(*_columns(length)).distinct(), "phrases-candidates")
    bits.destroy()
    n = candidates.count()
    shards = _shards(n, length)
    counts = [_counted(blocks, tries, length, shards, least) for tries in _tries(candidates, length, shards)] if n else []
    discard(candidates)
    return reduce(DataFrame.unionByName, counts) if n else None


def _dealt(occurrences: DataFrame, parts: int, length: int, least: int) -> DataFrame:
    """(w0, w1, ..., f): tries of what a task is dealt count it; a phrase is dealt to one task."""
    columns = _columns(length)
    most = max(1, min(PHRASES_PER_TRIE, MOST_WORDS // length))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        words, n = _matrix(table, length), table.column("n").to_numpy()
        order = np.lexsort(words.T[::-1])
        words, n = words[order], n[order]
        starts = run_starts(*words.T)
        for first in range(0, len(starts), most):
            trie = PhraseTrie(words[starts[first : first + most]])
            rows = slice(starts[first], starts[first + most] if first + most < len(starts) else len(words))
            text = np.zeros((rows.stop - rows.start, length + 1), np.uint64)
            text[:, :length] = words[rows]
            row, number = trie.occurrences(text.ravel(), np.arange(len(text)) * (length + 1))
            total = np.zeros(len(trie.phrases), np.int64)
            np.add.at(total, number, n[rows][row // (length + 1)])
            kept = total >= least
            spelled = trie.phrases[kept].view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(spelled[:, k].copy()) for k in range(length)), pa.array(total[kept])], [*columns, "f"])

    return occurrences.repartition(parts, *columns).mapInArrow(count, ", ".join(f"{c} long" for c in columns) + ", f long")


def _matrix(table: pa.Table, length: int) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in _columns(length)], axis=1).view(np.uint64).reshape(-1, length)


def _shards(rows: int, length: int) -> int:
    """Hashed shards that hold ``PHRASES_PER_TRIE`` phrases and ``MOST_WORDS`` words at most, with room to spare."""
    return max(1, -(-rows // min(PHRASES_PER_TRIE, MOST_WORDS * 9 // (10 * length))))


# A phrase's shard: bits of its words, each shifted by this more than the one before, the highest modulo the shards.
_SHIFT, _LOWEST = 7, 33


def _shard(columns: list[str], shards: int) -> Column:
    bits = reduce(Column.bitwiseXOR, [F.shiftleft(c, _SHIFT * k) for k, c in enumerate(columns)])
    return F.pmod(F.shiftrightunsigned(bits, _LOWEST), F.lit(shards))


def _shards_of(ids: np.ndarray, length: int, shards: int) -> np.ndarray:
    """The shard of the words that start at every position, as :func:`_shard` tells."""
    n = max(len(ids) - length + 1, 0)
    bits = ids[:n].copy()
    for k in range(1, length):
        bits ^= ids[k : n + k] << np.uint64(_SHIFT * k)
    return (bits >> np.uint64(_LOWEST)).astype(np.uint32) % np.uint32(shards)


def _tries(phrases: DataFrame, length: int, shards: int) -> Iterator[list[tuple[int, bytes]]]:
    """(shard, serialised trie) over all phrases, a bounded number at a time; each is built by a task of its own."""
    columns = _columns(length)
    dealt = phrases.select(*columns, _shard(columns, shards).alias("shard"))

    def build(group: pa.Table) -> pa.Table:
        trie = pickle.dumps(PhraseTrie(_matrix(group, length)))
        return pa.table({"shard": group.column("shard").slice(0, 1), "trie": pa.array([trie], pa.binary())})

    for first in range(0, shards, TRIES_AT_ONCE):
        part = dealt.where(F.col("shard").between(first, first + TRIES_AT_ONCE - 1))
        built = part.groupBy("shard").applyInArrow(build, "shard long, trie binary").toArrow()
        yield list(zip(built.column("shard").to_pylist(), built.column("trie").to_pylist()))


def _counted(blocks: DataFrame, tries: list[tuple[int, bytes]], length: int, shards: int, least: int) -> DataFrame:
    """(w0, w1, ..., f): the tries' phrases that occur ``least`` times, counted per task and added up, stored."""
    shared = blocks.sparkSession.sparkContext.broadcast([(shard, pickle.loads(t)) for shard, t in tries])
    columns = _columns(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, PhraseTrie]] = shared.value
        counts = [np.zeros(len(t.phrases), np.int64) for _, t in held]
        for ids, _ in _blocks(batches):
            of = _shards_of(ids, length, shards)
            for (shard, trie), total in zip(held, counts):
                total += np.bincount(trie.occurrences(ids, np.flatnonzero(of == shard))[1], minlength=len(total))
        for i, total in enumerate(counts):
            seen = np.flatnonzero(total).astype(np.int32)
            trie = np.full(len(seen), i, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(trie), pa.array(seen), pa.array(total[seen])], ["trie", "number", "f"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, PhraseTrie]] = shared.value
        for batch in batches:
            tries, numbers, counts = (column.to_numpy() for column in batch.columns)
            for i in np.unique(tries):
                mine = tries == i
                words = held[i][1].phrases[numbers[mine]].view(np.int64)
                arrays = [pa.array(words[:, k].copy()) for k in range(length)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts[mine])], [*columns, "f"])

    # Phrases travel as their numbers in the trie, which all tasks share.
    found = blocks.mapInArrow(run, "trie int, number int, f long").groupBy("trie", "number").agg(F.sum("f").alias("f"))
    found = found.where(F.col("f") >= least).mapInArrow(spell, ", ".join(f"{c} long" for c in columns) + ", f long")
    found = stored(found, f"phrases-{length}")
    shared.destroy()
    return found


Marker = Callable[[np.ndarray], np.ndarray]


def _trimmed_blocks(
    source: DataFrame, read: Callable, groups: Iterator[tuple[Callable[[], Marker], bool]], length: int
) -> DataFrame:
    """The texts trimmed by the marks of all groups; one pass a group, with the marks kept in between."""
    blocks = source
    for first, (marker, is_last) in enumerate(groups):
        reader = read if first == 0 else _blocks

        def run(batches, reader=reader, marker=marker, is_last=is_last) -> Iterator[pa.RecordBatch]:
            mark_of = marker()
            for ids, mark in reader(batches):
                now = mark_of(ids)
                mark = now if mark is None else mark | now
                if not is_last:
                    yield _block(ids, mark)
                    continue
                kept = trimmed(ids, mark, length)
                if len(kept):
                    yield _block(kept, None)

        before, blocks = blocks, stored(blocks.mapInArrow(run, _BLOCK_SCHEMA), f"phrases-texts-{length}")
        if first:
            discard(before)
    return blocks


def _markers(numbers: DataFrame, rows: int, mark_by: Callable) -> Iterator[tuple[Callable, bool]]:
    """Markers by sorted sets of at most some ``WORDS_AT_ONCE`` of the ``numbers`` (id) each, ``mark_by(known, text)``.

    A set is let go when the next one is asked for."""
    shards = max(1, -(-rows // WORDS_AT_ONCE))
    context = numbers.sparkSession.sparkContext
    for shard in range(shards):
        part = numbers.where(F.pmod(F.xxhash64(F.lit(32), "id"), F.lit(shards)) == shard).select("id").toArrow()
        shared = context.broadcast(np.sort(part.column("id").to_numpy().view(np.uint64)))

        def marker(shared=shared) -> Marker:
            known = shared.value
            return lambda text: mark_by(known, text)

        yield marker, shard == shards - 1
        shared.destroy()


def _among(known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(numbers), bool)
    at = np.searchsorted(known, numbers)
    at[at == len(known)] = 0
    return known[at] == numbers


def _phrase_markers(phrases: DataFrame, length: int, rows: int) -> Iterator[tuple[Callable, bool]]:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _matrix(pa.Table.from_batches([batch]), length).ravel()
            ids = _phrase_hash(words, np.arange(batch.num_rows) * length, length)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64))], ["id"])

    def mark_by(known: np.ndarray, text: np.ndarray) -> np.ndarray:
        found, at = np.zeros(len(text), bool), _safe_starts(text, length)
        found[at] = _among(known, _phrase_hash(text, at, length))
        return found

    return _markers(phrases.select(*_columns(length)).mapInArrow(number, "id long"), rows, mark_by)


def mine_phrases(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> Mined:
    """Words and phrases of 2 to ``longest`` words that occur at least ``least`` times in their language."""
    rows = _rows(docs, text, lang)
    for salt in range(8):
        vocabulary = stored(word_counts(rows, salt), "phrases-words")
        if vocabulary.groupBy("id").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            break
        discard(vocabulary)
    else:
        raise RuntimeError("word numbers collide under eight salts")
    totals = stored(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    words = stored(vocabulary.where(F.col("n") >= least).select("id", "lang", "word", F.col("n").alias("f")), "phrases-frequent")
    discard(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, None]]:
        return ((ids, None) for ids in _text_ids(batches, salt))

    blocks = _trimmed_blocks(rows, read, _markers(words, words.count(), _among), 1)
    levels: list[DataFrame] = []
    for length in range(2, longest + 1):
        frequent = _frequent(blocks, length, least)
        if frequent is None:
            break
        levels.append(frequent.select(F.array(*_columns(length)).alias("w"), "f"))
        if length < longest:
            before = blocks
            blocks = _trimmed_blocks(blocks, _blocks, _phrase_markers(frequent, length, frequent.count()), length)
            discard(before)
    discard(blocks)
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "w array<bigint>, f long")
    return Mined(totals, words, reduce(DataFrame.unionByName, levels, empty))


def scored_phrases(mined: Mined, scale: int = 1_000_000, share: int = 50) -> DataFrame:
    """(w, a, l, r, score) of the phrases that no longer one with ``share`` per cent of their count holds.

    ``l`` and ``r`` belong to the lowest-scoring cut, of equals the first.
    """
    counts = mined.words.select(F.array("id").alias("w"), "f").unionByName(mined.phrases)
    cuts = mined.phrases.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("w", 1, F.col("k")).alias("left"), F.expr("slice(w, k + 1, size(w) - k)").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select(F.col("w").alias(side), F.col("f").alias(name)), side)
    wide = {c: F.col(c).cast("decimal(14,0)") for c in "alr"}
    top = (wide["a"] * wide["a"]).cast("decimal(29,0)") * F.lit(scale).cast("decimal(7,0)")
    ratio = cuts.withColumn("_top", top.cast("decimal(38,0)")).withColumn(
        "_below", (wide["l"] * wide["r"]).cast("decimal(29,0)").cast("decimal(38,0)")
    )
    # The fixed-point quotient is exact where it is whole, and its floor is `div`.
    least = ratio.withColumn("score", F.expr("_top div _below")).groupBy("w", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    part = mined.phrases.where(F.size("w") > 2).select(
        F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"), "f"
    )
    # What is held by a phrase of two words more is held by one of the phrases between, which occurs as often at least.
    held = part.groupBy("w").agg(F.max("f").alias("held"))
    return (
        least.join(held, "w", "left")
        .where(F.coalesce(F.col("held") * 100 < F.col("a") * share, F.lit(True)))
        .select("w", "a", "cut.l", "cut.r", "cut.score")
    )


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    share: int = 50,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and phrase."""
    mined = mine_phrases(docs, longest, least, text, lang)
    scored = stored(scored_phrases(mined, share=share), "phrases-scored")
    spelled = (
        scored.select("w", F.posexplode("w").alias("at", "id"))
        .join(mined.words.select("id", "lang", "word"), "id")
        .groupBy("w")
        .agg(
            F.first("lang").alias("lang"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        )
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = scored.join(spelled, "w").withColumn("_part", F.pmod(F.xxhash64(F.lit(33), "w"), F.lit(256)))
    # First inside parts of a language, so that no task ranks all of a large one.
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    best = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return best.where(F.col("rank") <= top).join(mined.totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
