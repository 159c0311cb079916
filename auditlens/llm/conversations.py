"""Repair of conversation structure by a rank-convergence parallel Viterbi.

The turns of a conversation are edited at least cost until their roles read system? (user assistant)+, or none
are left: keep (0; 3 more for an undeleted truncated turn), give another role (3), delete (4; blank and duplicate
turns must go), insert an empty turn (3). A state is what the repaired roles end with: nothing, s, u or a. The
costs to the end from the four states are a vector; a turn maps the vector after it to the one before it.

Turns are sorted by ranges, so a conversation lies in one partition, or in several neighbouring ones if it is
long: its part in a partition is a chunk. Every chunk is run backwards at once from a speculative vector. Costs
differ by a bounded amount, so up to a constant there are few vectors, and soon the vectors inside a chunk no
longer depend on the one it started from: a fix-up pass with the vector that the chunk behind it really hands over
runs only until its vector equals the stored one up to a constant. Passes are repeated until no chunk is asked
for a vector it has not answered; as a vector found anywhere in a conversation is tried on all of its open
chunks, their number is bounded by the number of vectors, whatever the data. What the driver stitches is a vector
and a state per chunk of a conversation that crosses a border, at most two per partition. With the costs settled,
each chunk is traced forwards on its own, for the four states it may start in; the states are stitched likewise.
The trace takes the least letter among the cheapest edits, so it gives the least audit.

* a null role or text is one space; null turns come first, equal turns are ordered by role, text start and digest
* a null conversation is a conversation; rows equal in everything are duplicates of each other
* a conversation without turns has no row here; an empty table gives empty results
* texts are never gathered but 64 turns at a time; digests stream over a conversation in order
* the columns read are renamed first, so that others may have any name
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import join_groups

BLANKS = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)

# States: nothing yet, system, user, assistant. Only nothing and assistant may end a conversation.
NOTHING, S, U, A = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
_AFTER_INSERT = (U, U, A, U)
_KEEPS = {(NOTHING, 0): S, (NOTHING, 1): U, (S, 1): U, (A, 1): U, (U, 2): A}
AT_END = (0, 2 * INSERT, INSERT, 0)

# Edits as single characters: K and D, then giving and inserting the roles user and assistant.
GIVE = {U: "p", A: "q"}
ADD = {U: "x", A: "y"}
LETTERS = ("pqxy", "RRII")

_PART_SHIFT = 33
_BLOCK_SHIFT = 6


def _consumed(after: tuple, code: int, q: int) -> list[tuple[str, int, int, int]]:
    """(letter, rank, cost, next state) of the edits of a turn that must not be deleted by rule."""
    kind, cut = code & 3, CUT if code >> 2 == TRUNCATED else 0
    edits = [("D", 0, DELETE + after[q], q)]
    if (q, kind) in _KEEPS:
        edits.append(("K", 2, cut + after[_KEEPS[q, kind]], _KEEPS[q, kind]))
    given = _AFTER_INSERT[q]
    edits.append((GIVE[given], 3, REROLE + cut + after[given], given))
    return edits


class Steps:
    """One turn back, one turn forth; both remembered, as vectors up to a constant are few."""

    def __init__(self) -> None:
        self.backward: dict = {}
        self.forward: dict = {}

    def back(self, after: tuple, code: int) -> tuple[tuple, int]:
        """(vector before the turn less its least cost, that cost)."""
        found = self.backward.get((after, code))
        if found is None:
            costs = self._costs(after, code)
            least = min(costs)
            found = self.backward[after, code] = (tuple(c - least for c in costs), least)
        return found

    @staticmethod
    def _costs(after: tuple, code: int) -> list[int]:
        if code >> 2 >= DUPLICATE:
            return [DELETE + c for c in after]
        direct = [min(e[2] for e in _consumed(after, code, q)) for q in range(4)]
        once = [min(direct[q], INSERT + direct[_AFTER_INSERT[q]]) for q in range(4)]
        return [min(once[q], INSERT + once[_AFTER_INSERT[q]]) for q in range(4)]

    def forth(self, after: tuple, code: int, q: int) -> tuple[str, int, int]:
        """(edits up to and with the turn's own, next state, cost): the least letters of the cheapest."""
        found = self.forward.get((after, code, q))
        if found is None:
            found = self.forward[after, code, q] = self._traced(after, code, q)
        return found

    def _traced(self, after: tuple, code: int, q: int) -> tuple[str, int, int]:
        if code >> 2 >= DUPLICATE:
            return "D", q, DELETE
        costs = self._costs(after, code)
        edits, spent = "", 0
        while True:
            cheapest = [e for e in _consumed(after, code, q) if e[2] == costs[q]]
            insert = INSERT + costs[_AFTER_INSERT[q]] == costs[q]
            letter, rank, total, then = min(cheapest, key=lambda e: e[1]) if cheapest else ("", 9, 0, q)
            if insert and rank > 1:
                q = _AFTER_INSERT[q]
                edits, spent = edits + ADD[q], spent + INSERT
                continue
            return edits + letter, then, spent + total - after[then]

    def run_back(self, codes: bytes, end: tuple) -> list[tuple]:
        """The vectors after every turn, the one before the first turn in front."""
        vectors = [end]
        for code in reversed(codes):
            vectors.append(self.back(vectors[-1], code)[0])
        vectors.reverse()
        return vectors

    def start_of(self, codes: bytes, end: tuple, trail: list[tuple]) -> tuple:
        """The vector before the first turn, reading on from ``trail`` as soon as a vector equals its own."""
        vector = end
        for i in range(len(codes) - 1, -1, -1):
            if vector == trail[i + 1]:
                return trail[0]
            vector = self.back(vector, codes[i])[0]
        return vector

    def trace(self, codes: bytes, vectors: list[tuple], q: int, ends: bool) -> tuple[list[str], int, int]:
        """(edits per turn, state after the last turn, cost); insertions behind the last turn go with it."""
        edits, cost = [], 0
        for code, after in zip(codes, vectors[1:]):
            now, q, spent = self.forth(after, code, q)
            edits.append(now)
            cost += spent
        while ends and q in (S, U):
            q = _AFTER_INSERT[q]
            edits[-1] += ADD[q]
            cost += INSERT
        return edits, q, cost


@dataclass
class Repaired:
    """``turns`` (conv, pos, role, text, edits) in the order of ``pos``; ``chunks``, what is counted per chunk."""

    turns: DataFrame
    chunks: DataFrame


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, kind, fault, digest, pos): ``pos`` grows along every conversation."""
    plain = rows.select(
        F.struct(F.col(conv).alias("id")).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    last = F.substring(rest, -1, 1)
    fault = F.when(rest == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    told = plain.select(
        "*",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("kind"),
        fault.alias("fault"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.substring("text", 1, 40).alias("_start"),
        # Equal rows may be in any order; this lets a border fall among them.
        F.monotonically_increasing_id().alias("_any"),
    )
    keys = ["conv", "turn", "role", "_start", "digest", "_any"]
    sorted_rows = told.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(
        sorted_rows.select(
            "conv", "turn", "role", "text", "kind", "fault", "digest", F.monotonically_increasing_id().alias("pos")
        ),
        "conversations-turns",
    )


def _chunks(turns: DataFrame) -> DataFrame:
    """(conv, part, at, positions, codes): the turns of a conversation in one partition; ``at`` is its first position."""
    spoken = turns.where(F.col("fault") != BLANK).select("conv", "digest", "pos")
    repeated = spoken.groupBy("conv", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("times"))
    repeated = stored(repeated.where("times > 1"), "conversations-repeated")
    duplicates = join_groups(spoken, repeated, ["conv", "digest"], "times").where("pos > first")
    marks = turns.select("conv", "pos", "kind", "fault").unionByName(
        duplicates.select("conv", "pos", F.lit(0).alias("kind"), F.lit(DUPLICATE).alias("fault"))
    )
    part = F.shiftright("pos", _PART_SHIFT).cast("int")
    listed = marks.groupBy("conv", part.alias("part")).agg(
        F.collect_list(F.struct("pos", "kind", "fault")).alias("turns"), F.min("pos").alias("at")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions, codes = [], []
            for value in batch.column(2):
                pos, kind, fault = (f.to_numpy(zero_copy_only=False) for f in value.values.flatten())
                at, where = np.unique(pos, return_inverse=True)
                kinds, faults = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
                np.maximum.at(kinds, where, kind.astype(np.uint8))
                np.maximum.at(faults, where, fault.astype(np.uint8))
                positions.append(at.astype(np.int64).tobytes())
                codes.append((faults << 2 | kinds).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(positions, pa.binary()), pa.array(codes, pa.binary())],
                ["conv", "part", "at", "positions", "codes"],
            )

    conv = turns.schema["conv"].dataType.simpleString()
    packed = listed.mapInArrow(pack, f"conv {conv}, part int, at long, positions binary, codes binary")
    return stored(packed, "conversations-chunks")


def _trail(codes: bytes, end: tuple = AT_END) -> tuple[list[tuple], bytes]:
    """Vectors after every turn from the speculative one, as distinct vectors and a number for each place."""
    names: dict[tuple, int] = {}
    places = bytes(names.setdefault(v, len(names)) for v in Steps().run_back(codes, end))
    return list(names), places


def _settled(crossing: DataFrame) -> dict[int, tuple[tuple, int, bool]]:
    """{at: (vector after the chunk, state before it, whether it is the last)} of the chunks of conversations that cross a border."""

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trails = [_trail(c.as_py()) for c in batch.column("codes")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv", "part", "at", "codes")),
                    pa.array([t[0] for t in trails], pa.list_(pa.list_(pa.int32()))),
                    pa.array([t[1] for t in trails], pa.binary()),
                ],
                ["conv", "part", "at", "codes", "vectors", "places"],
            )

    conv = crossing.schema["conv"].dataType.simpleString()
    run = stored(
        crossing.mapInArrow(
            speculate, f"conv {conv}, part int, at long, codes binary, vectors array<array<int>>, places binary"
        ),
        "conversations-trails",
    )
    chains: dict = {}
    answers: dict[tuple[int, tuple], tuple] = {}
    starts = run.select("conv", "part", "at", "vectors", F.substring("places", 1, 1).alias("place"))
    for row in starts.collect():
        chains.setdefault(row.conv, []).append((row.part, row.at))
        answers[row.at, AT_END] = tuple(row.vectors[row.place[0]])
    for chain in chains.values():
        chain.sort()
    ends: dict[int, tuple] = {}
    while True:
        asked: dict[int, set[tuple]] = {}
        for chain in chains.values():
            vector = AT_END
            for i in range(len(chain) - 1, -1, -1):
                at = chain[i][1]
                ends[at] = vector
                if (at, vector) not in answers:
                    for _, open_at in chain[: i + 1]:
                        if (open_at, vector) not in answers:
                            asked.setdefault(open_at, set()).add(vector)
                    break
                vector = answers[at, vector]
        if not asked:
            break
        answers.update(_answered(run, asked))
    states = _states(run, ends)
    found = {}
    for chain in chains.values():
        q = NOTHING
        for i, (_, at) in enumerate(chain):
            found[at] = (ends[at], q, i == len(chain) - 1)
            q = states[at][q]
    return found


def _answered(run: DataFrame, asked: dict[int, set[tuple]]) -> dict:
    """A fix-up pass: the start vectors of chunks for the vectors asked of them."""
    shared = run.sparkSession.sparkContext.broadcast(asked)

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            out = []
            for at, codes, vectors, places in zip(*(batch.column(c) for c in ("at", "codes", "vectors", "places"))):
                wanted = shared.value.get(at.as_py(), ())
                if not wanted:
                    continue
                names = [tuple(v) for v in vectors.as_py()]
                trail = [names[p] for p in places.as_py()]
                out += [(at.as_py(), list(v), list(steps.start_of(codes.as_py(), v, trail))) for v in sorted(wanted)]
            columns = zip(*out) if out else ([], [], [])
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["at", "after", "before"])

    rows = run.mapInArrow(fix, "at long, after array<int>, before array<int>").collect()
    return {(r.at, tuple(r.after)): tuple(r.before) for r in rows}


def _states(run: DataFrame, ends: dict[int, tuple]) -> dict[int, list[int]]:
    """The state behind each chunk for each state before it."""
    shared = run.sparkSession.sparkContext.broadcast(ends)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            then = []
            for at, codes in zip(batch.column("at"), batch.column("codes")):
                vectors = steps.run_back(codes.as_py(), shared.value[at.as_py()])
                then.append([steps.trace(codes.as_py(), vectors, q, False)[1] for q in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(then, pa.list_(pa.int32()))], ["at", "then"])

    return {r.at: r.then for r in run.mapInArrow(follow, "at long, then array<int>").collect()}


def _traced(chunks: DataFrame, settled: dict) -> DataFrame:
    """Edits and counts of every chunk: (conv, part, at, positions, edits, cost, counts by fault, illegal pairs, ...)."""
    shared = chunks.sparkSession.sparkContext.broadcast(settled)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            rows = []
            for at, positions, codes in zip(*(batch.column(c) for c in ("at", "positions", "codes"))):
                codes = codes.as_py()
                end, q, ends = shared.value.get(at.as_py(), (AT_END, NOTHING, True))
                edits, _, cost = steps.trace(codes, steps.run_back(codes, end), q, ends)
                told = np.frombuffer(codes, np.uint8)
                kinds, faults = told & 3, told >> 2
                legal = np.isin(kinds[:-1] * 4 + kinds[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
                rows.append(
                    (
                        np.frombuffer(positions.as_py(), np.int64).tolist(),
                        edits,
                        cost,
                        *(int((faults == f).sum()) for f in (TRUNCATED, DUPLICATE, BLANK)),
                        int((~legal).sum()),
                        int(kinds[0]),
                        int(kinds[-1]),
                    )
                )
            kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 5, pa.int32(), pa.int32())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("part"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["conv", "part", "positions", "edits", "cost", "truncated", "duplicate", "blank", "illegal", "first", "last"],
            )

    conv = chunks.schema["conv"].dataType.simpleString()
    schema = (
        f"conv {conv}, part int, positions array<long>, edits array<string>, cost long, truncated long, "
        "duplicate long, blank long, illegal long, first int, last int"
    )
    return stored(chunks.mapInArrow(trace, schema), "conversations-edits")


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repaired:
    """The cheapest edits of every turn, of equally cheap ones those with the least letters."""
    turns = ordered_turns(rows, conv, turn, role, text)
    chunks = _chunks(turns)
    several = chunks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    crossing = stored(chunks.join(several, "conv", "left_semi"), "conversations-crossing")
    traced = _traced(chunks, _settled(crossing))
    edits = traced.select(F.explode(F.arrays_zip("positions", "edits")).alias("e")).select(
        F.col("e.positions").alias("pos"), F.col("e.edits").alias("edits")
    )
    return Repaired(turns.join(edits, "pos"), traced)


def _lines(edits: Column, role: Column, text: Column) -> Column:
    """``role:text`` of what a turn's edits leave, in order."""

    def line(c: Column) -> Column:
        return (
            F.when(c == "K", F.concat(role, F.lit(":"), text))
            .when(c == GIVE[U], F.concat(F.lit("user:"), text))
            .when(c == GIVE[A], F.concat(F.lit("assistant:"), text))
            .when(c == ADD[U], F.lit("user:"))
            .when(c == ADD[A], F.lit("assistant:"))
        )

    return F.filter(F.transform(F.split(edits, ""), line), F.isnotnull)


def repaired_turns(repaired: Repaired) -> DataFrame:
    """(conv, pos, place, line): the repaired conversations, a row per turn, ordered by (pos, place)."""
    lines = _lines(F.col("edits"), F.col("role"), F.col("text"))
    return repaired.turns.select("conv.id", "pos", F.posexplode(lines).alias("place", "line"))


def _digests(repaired: Repaired) -> DataFrame:
    """(conv, sha): sha256 of the lines joined by newlines. A digest runs over its conversation in order, so all of
    it passes through one task, as a stream of blocks of 64 turns; nothing of it is kept but the digest's state."""
    lines = repaired.turns.select(
        "conv", "pos", F.array_join(_lines(F.col("edits"), F.col("role"), F.col("text")), "\n").alias("lines")
    ).where("lines <> ''")
    blocks = lines.groupBy("conv", F.shiftright("pos", _BLOCK_SHIFT).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"]), "\n").alias("lines")
    )
    schema = blocks.schema["conv"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([current, pa.array([state.hexdigest()])], ["conv", "sha"])

        for batch in batches:
            for i in range(batch.num_rows):
                conv = batch.column(0).slice(i, 1)
                if state is None or conv != current:
                    if state is not None:
                        yield out()
                    state, current = hashlib.sha256(), conv
                else:
                    state.update(b"\n")
                state.update(batch.column(2)[i].as_py().encode())
        if state is not None:
            yield out()

    streamed = blocks.repartition("conv").sortWithinPartitions("conv", "block")
    return streamed.mapInArrow(digest, f"conv {schema}, sha string")


def conversation_report(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation with turns: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    repaired = repair_conversations(rows, conv, turn, role, text)
    numbered = repaired.turns.groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    gaps = numbered.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    letters = F.translate(F.array_join("edits", ""), *LETTERS)
    whole = repaired.chunks.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_sort(F.collect_list(F.struct("part", letters.alias("letters"), "first", "last"))).alias("parts"),
    )
    # Neighbouring turns of two chunks; legal are su, ua and au.
    borders = F.zip_with(
        F.expr("slice(parts, 1, size(parts) - 1)"),
        F.expr("slice(parts, 2, size(parts) - 1)"),
        lambda x, y: F.when((x["last"] * 4 + y["first"]).isin(1, 6, 9), 0).otherwise(1),
    )
    illegal = F.col("illegal") + F.aggregate(borders, F.lit(0).cast("bigint"), lambda s, x: s + x)
    report = whole.join(gaps, "conv").join(_digests(repaired), "conv", "left")
    return report.select(
        F.col("conv.id").alias("id"),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        illegal.alias("illegal"),
        "cost",
        F.array_join(F.transform("parts", lambda p: p["letters"]), "").alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
