"""Byte-pair encoding with forced boundaries, and decoding.

A merge can only join symbols that stand side by side inside some vocabulary token. A pair of symbols
that no token contains is therefore a certain cut: the pieces on either side are encoded by themselves
and the ids put one after the other. Words repeat, so each task keeps the ids of the pre-tokens
it has seen last in a bounded dictionary.

The rules of the tokenizer file are applied as they stand: canonical composition, white space,
lower case, splitting by pattern, bytes as symbols, a suffix at the end of a word, special tokens.

* a null or empty text has no ids; every text is encoded whole, white space of any kind separates words
* other columns are never read; an empty table gives an empty result
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Recent

# Fixed values of the file format: white space as its patterns see it, and the bytes shown as themselves.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

KEPT_TOKENS = 200_000
LONG_TOKEN = 64
# Pieces up to this many symbols are merged by plain scans, longer ones with a heap.
SCANNED = 24
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """A printable character for every byte: itself where shown, else the next one from U+0100 on."""
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(SHOWN) else chr(next(hidden)) for b in range(256)]


class BytePairs:
    """The vocabulary of one tokenizer file, with its certain cuts."""

    def __init__(self, text: str) -> None:
        rules = json.loads(text)
        model = rules["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        steps = rules["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.space = regex.compile(SPACE)
        # Symbols outside the vocabulary are numbered after it: they can be merged, but have no id of their own.
        self.numbers = dict(self.vocab)
        beyond = 1 + max(self.names)

        def number(symbol: str) -> int:
            return self.numbers.setdefault(symbol, beyond + len(self.numbers))

        self.symbols = byte_symbols()
        self.inner = [number(c) for c in self.symbols]
        self.last = [number(c + self.suffix) for c in self.symbols]
        self.ranks = {(number(a), number(b)): i for i, (a, b) in enumerate(pairs)}
        self.joined = [number(a + b) for a, b in pairs]
        self.known = set(self.vocab.values())
        self.inside = set()
        for token in self.vocab:
            parts = self.symbols_of_token(token)
            self.inside.update(zip(parts, parts[1:]))
        self.uncut = {(number(a), number(b)) for a, b in self.inside}
        self.tokens = Recent(self._token, KEPT_TOKENS, LONG_TOKEN)

    def symbols_of_token(self, token: str) -> list[str]:
        ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
        shown = list(token[: -len(self.suffix)] if ends else token)
        if ends:
            shown[-1] += self.suffix
        return shown

    def merged(self, piece: tuple[str, ...]) -> list[int]:
        """Ids of one piece, given as symbols."""
        return [i for i in self.merge([self.numbers[c] for c in piece]) if i in self.known]

    def merge(self, piece: list[int]) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals; changes ``piece``."""
        if len(piece) == 1:
            return piece
        if len(piece) > SCANNED:
            return self.merge_by_heap(piece)
        get, joined = self.ranks.get, self.joined
        ranks = [get(pair, NEVER) for pair in zip(piece, piece[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NEVER:
                break
            i = ranks.index(rank)
            piece[i : i + 2] = [joined[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((piece[i - 1], piece[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((piece[i], piece[i + 1]), NEVER)
        return piece

    def merge_by_heap(self, piece: list[int]) -> list[int]:
        """The same with a heap over linked neighbours, for pieces of any length."""
        parts: list[int | None] = list(piece)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        ranks = self.ranks
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(piece, piece[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = self.joined[rank], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                pair = (parts[i], parts[after[i]])
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            if before[i] >= 0:
                pair = (parts[before[i]], parts[i])
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], before[i], *pair))
        return [p for p in parts if p is not None]

    def token_ids(self, token: str) -> list[int]:
        """Ids of one pre-token: cut where no vocabulary token has the pair, encode the pieces, concatenate."""
        data = token.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in self.uncut]
        if not cuts:
            ids = self.merge(symbols)
        else:
            ends = zip([0, *cuts], [*cuts, len(symbols)])
            ids = [i for start, end in ends for i in self.merge(symbols[start:end])]
        return [i for i in ids if i in self.known]

    def _token(self, token: str) -> tuple[str, int, str]:
        """(decimal ids joined by a space, their number, decoded text) of one pre-token."""
        ids = [self.special[token]] if token in self.special else self.token_ids(token)
        return " ".join(map(str, ids)), len(ids), self.decoded(ids)

    def pre_tokens(self, text: str) -> list[str]:
        """What the file's pattern makes of text without special tokens; it passes over white space of any kind."""
        composed = text if text.isascii() else unicodedata.normalize("NFC", text)
        # Character by character: no rule about the end of a word.
        return self.pattern.findall(composed.replace("Σ", "σ").lower())

    def split_text(self, text: str) -> list[str]:
        """Pre-tokens of any text, special tokens among them as they stand."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pre_tokens(text)
        found: list[str] = []
        for part in self.split.split(text):
            found += [part] if part in self.special else self.pre_tokens(part)
        return found

    def split_words(self, text: str) -> list[str]:
        """Runs between white space; no rule of the file reaches across it."""
        return [w for w in self.space.split(text) if w]

    def encoded(self, text: str) -> list[tuple[str, int, str]]:
        """What :meth:`_token` says of every pre-token that has ids."""
        return [t for t in map(self.tokens.__getitem__, self.split_text(text)) if t[1]]

    def ids(self, text: str) -> list[int]:
        return [int(i) for t in self.encoded(text) for i in t[0].split()]

    def decoded(self, ids: list[int]) -> str:
        """The tokens joined by a space, as the file names no decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[int, BytePairs] = {}


def _tokenizer(rules) -> BytePairs:
    """The tokenizer of a broadcast file, built once per worker process."""
    text = rules.value
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BytePairs(text)
    return _LOADED[key]


def _shipped(docs: DataFrame, path: str):
    """The tokenizer file, some MB whatever the corpus, for every worker; the driver alone reads the path."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) of every row; ``path`` is the tokenizer file."""
    rules = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _tokenizer(rules)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [pairs.ids(v.as_py().decode("utf-8", "replace")) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = _texts(docs, key, text)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids): the decoded text, empty for null ids."""
    rules = _shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _tokenizer(rules)
        for batch in batches:
            texts = [pairs.decoded([i for i in v.as_py() or [] if i is not None]) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what :func:`encode_texts` and :func:`decode_ids` give, as
    digests taken beside the ids, so that neither ids nor decoded texts leave the task."""
    rules = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _tokenizer(rules)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                found = pairs.encoded(value.as_py().decode("utf-8", "replace"))
                counts.append(sum([w[1] for w in found]))
                ids.append(hashlib.sha256(" ".join([w[0] for w in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([w[2] for w in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = _texts(docs, key, text)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
