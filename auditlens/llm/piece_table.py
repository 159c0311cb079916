"""SentencePiece encoding by a table of last pieces, and decoding.

A model of merge type joins neighbouring symbols, best score first and leftmost of equals, as long as the
joined text is a piece. Two facts make a table possible, whatever route a piece was merged by. A sequence of
pieces is the encoding of its text exactly if every neighbouring pair is the encoding of its own text: the
first merge across a border would be chosen in the pair too. And every prefix of a text has one encoding, so
one last piece. So, from left to right, the pieces that end at a position are found by an automaton over all
pieces, the one that goes with the last piece of the prefix before it is stored, and the ids are read
backwards from the end.

* a pair is tested by replaying the merges of both pieces side by side: it fails when a merge across the
  border is next; results are kept in a bounded dictionary
* a character that no piece holds is never merged: it stands for its bytes, and the table starts anew
* texts are cut before a run of spaces when no piece holds another character before one, between letters and
  other characters when no piece holds both, and around line ends and tabs that no piece holds; the ids of
  short stretches are kept in a bounded dictionary
* a null or empty text has the end id alone, as without any text there is no leading space either; texts are
  encoded whole, in time and memory proportional to their length; invalid UTF-8 counts as U+FFFD
* equal rows give equal results; other columns are never read; an empty table gives an empty result
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Recent

SPACE = "▁"

# Fixed values of the model file's format: kinds of pieces, and the number of the merge type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2

KEPT_STRETCHES = 200_000
KEPT_PAIRS = 400_000
LONG_STRETCH = 48
ROWS_AT_ONCE = 200

# Last piece of a prefix that ends with a character outside all pieces.
FOREIGN = -2


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message: numbers, or the bytes of anything else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = number()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """The pieces of one model file of merge type with byte fallback and unchanged characters."""

    def __init__(self, data: bytes) -> None:
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in message_fields(data):
            if number == 1:
                piece = dict(message_fields(value))
                self.names.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(message_fields(value))
            elif number == 3:
                normalizer = dict(message_fields(value))
        if trainer.get(3) != MERGE_TYPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only merge models that change no character and drop no space are read")
        if not trainer.get(35) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are read")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8")
        self.end = trainer.get(42, 2)
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.scores = {n: scores[i] for i, n in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.alphabet = {c for n in self.scores for c in n}
        # Characters inside pieces that are no pieces themselves can be merged, but stand for bytes alone.
        self.symbols = [*self.names, *sorted(self.alphabet - self.scores.keys())]
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(self.symbols):
            if i >= len(self.names) or self.kinds[i] == NORMAL:
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.merges: dict[int, tuple[str, str, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.shown = {i: n.replace(SPACE, " ") for i, n in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.stretches = Recent(self._stretch, KEPT_STRETCHES, LONG_STRETCH)
        self.cut = re.compile(self._certain_cuts())

    def _certain_cuts(self) -> str:
        """A pattern whose matches, side by side, are the stretches no piece reaches out of."""
        inner = {(b, c) for n in self.scores for b, c in zip(n, n[1:])}
        if any(c == SPACE != b for b, c in inner):
            return "(?s).+"
        lines = re.escape("".join(c for c in "\n\r\t" if c not in self.alphabet) or "\0")
        letters = {c for c in self.alphabet if c.isalpha()}
        if any(SPACE != b and (b in letters) != (c in letters) for b, c in inner):
            return f"[{lines}]+|{SPACE}*[^{SPACE}{lines}]+|{SPACE}+"
        letter = re.escape("".join(sorted(letters)))
        return f"[{lines}]+|{SPACE}*(?:[{letter}]+|[^{SPACE}{lines}{letter}]+)|{SPACE}+"

    def merges_of(self, token: int) -> tuple[str, str, list] | None:
        """First and last character, and the merges of a piece's text by itself in their order, each as (score,
        first symbol, last symbol) after it; None when they do not end in the piece."""
        if token not in self.merges:
            parts = list(self.symbols[token])
            first, last, steps = parts[0], parts[-1], []
            while len(parts) > 1:
                joined = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
                if not joined:
                    break
                score, i = min(joined)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                steps.append((-score, parts[0], parts[-1]))
            self.merges[token] = (first, last, steps) if len(parts) == 1 else None
        return self.merges[token]

    def goes_with(self, left: int, right: int) -> bool:
        """Whether the text of two pieces is encoded as just these two."""
        a, b = self.merges_of(left), self.merges_of(right)
        if a is None or b is None:
            return False
        (_, x, before), (y, _, after) = a, b
        i = j = 0
        while True:
            across = self.scores.get(x + y)
            on_left = before[i][0] if i < len(before) else None
            on_right = after[j][0] if j < len(after) else None
            if (
                across is not None
                and (on_left is None or across > on_left)
                and (on_right is None or across >= on_right)
            ):
                return False
            if on_left is None and on_right is None:
                return True
            if on_right is None or (on_left is not None and on_left >= on_right):
                x = before[i][2]
                i += 1
            else:
                y = after[j][1]
                j += 1

    def last_pieces(self, stretch: str) -> list[int]:
        """For every prefix the last piece of its encoding; -1 for the empty one."""
        last = [-1] * (len(stretch) + 1)
        if not self.alphabet.issuperset(stretch):
            for i, c in enumerate(stretch, 1):
                if c not in self.alphabet:
                    last[i] = FOREIGN
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(stretch):
            if last[end + 1] != -1:
                continue
            before = last[end + 1 - size]
            if before >= 0:
                key = before << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.goes_with(before, token)
                if fits:
                    last[end + 1] = token
            elif (before == FOREIGN or end + 1 == size) and self.merges_of(token) is not None:
                last[end + 1] = token
        return last

    def stretch_ids(self, stretch: str) -> list[int]:
        """Ids of a stretch between certain cuts, read backwards from its table."""
        last = self.last_pieces(stretch)
        ids: list[int] = []
        at = len(stretch)
        while at:
            token = last[at]
            if 0 <= token < len(self.names):
                ids.append(token)
                at -= len(self.names[token])
            else:
                ids += [self.bytes[b] for b in reversed(stretch[at - 1].encode("utf-8"))]
                at -= 1
        ids.reverse()
        return ids

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def _stretch(self, stretch: str) -> tuple[str, int, str]:
        """(decimal ids joined by a space, their number, decoded text with all spaces) of one stretch."""
        ids = self.stretch_ids(stretch)
        return " ".join(map(str, ids)), len(ids), self.surface(ids)

    def ids(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return [*(i for s in self.split(text) for i in self.stretch_ids(s)), self.end]

    def surface(self, ids: list[int]) -> str:
        """The text of ids with every space that pieces stand for; invalid bytes give U+FFFD each."""
        if self.shown.keys() >= set(ids):
            return "".join([self.shown[i] for i in ids])
        parts: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                parts.append(_characters(bytes(pending)))
                pending.clear()
            if self.kinds[i] == UNKNOWN:
                parts.append(self.unknown)
            elif self.kinds[i] != CONTROL:
                parts.append(self.names[i].replace(SPACE, " "))
        if pending:
            parts.append(_characters(bytes(pending)))
        return "".join(parts)

    def decoded(self, ids: list[int]) -> str:
        """The text of ids: the space that encoding puts before a text is taken off again."""
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        opens = first is not None and self.kinds[first] == NORMAL and self.names[first].startswith(SPACE)
        return text[1:] if self.prefix and opens else text


def _characters(data: bytes) -> str:
    """UTF-8 characters; every byte that is not part of one becomes U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as error:
        return data[: error.start].decode("utf-8") + "�" + _characters(data[error.start + 1 :])


_LOADED: dict[int, PieceModel] = {}


def _model(shipped) -> PieceModel:
    """The model of a broadcast file, built once per worker process."""
    data = shipped.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(data)
    return _LOADED[key]


def _shipped(df: DataFrame, path: str):
    """The model file, under a MB whatever the corpus, for every worker; the driver alone reads the path."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) of every row, the end id last; ``path`` is the model file."""
    model = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids = [pieces.ids(v.as_py().decode("utf-8", "replace")) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = _rows(docs, key, text)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids): the decoded text, empty for null ids; null ids inside are left out."""
    model = _shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts = [pieces.decoded([i for i in v.as_py() or [] if i is not None]) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what :func:`encode_texts` and :func:`decode_ids` give, as
    digests taken beside the ids, so that neither ids nor decoded texts leave the task."""
    model = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        known = pieces.stretches
        end = str(pieces.end)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                found = [known[s] for s in pieces.split(value.as_py().decode("utf-8", "replace"))]
                text = "".join([f[2] for f in found])
                counts.append(sum([f[1] for f in found]) + 1)
                ids.append(hashlib.sha256(" ".join([*[f[0] for f in found], end]).encode()).hexdigest())
                decoded.append(hashlib.sha256((text[1:] if pieces.prefix else text).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = _rows(docs, key, text)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
