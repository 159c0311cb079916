"""Language-model scores: prediction by partial matching over bytes, and a word-count base.

The model is a trie of byte contexts, ``ORDER`` deep, learned from all training texts. The deepest contexts count
symbols; a shorter context counts a symbol once for every context a byte longer that has seen it (update
exclusion), so what only one longer context explains weighs little. Of a context with counts n, in all T, of d
different symbols, a symbol has probability (n - D) / T, and D * d / T is the escape to the context shorter by a
byte, where the symbols already seen are excluded from all counts. D is estimated for every order from the cells
seen once and twice, n1 / (n1 + 2 * n2). Below the empty context every symbol left is equally likely. A text
starts after ends and closes with an end symbol.

Nothing of the trie is gathered, broadcast or held as a table of all contexts. Texts are dealt into blocks of
bounded bytes by a hash; a block writes the distinct (context, symbol) cells and words it holds with their counts.
Summed by cell they are the deepest level; every shorter level is the one above grouped by suffix. Joins on the
suffix and windows over a context (at most 257 rows each) then work out one probability per cell, level by
level, and the blocks get those of the cells they hold.

The base is a smoothed unigram model of words, whose counts come from the same blocks.

* a null text is empty: it scores its end alone; a training id is decided by crc32 of the id as text
* rows without id count as the empty id text; rows that repeat train and score each by themselves
* without training texts all symbols are equally likely and no word is known
* other columns are never read; an empty table gives an empty result
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import id_remainder, n_bytes

END = 256
SYMBOLS = 257
# Bytes of the longest context; a cell of up to six and its symbol fits 64 bits.
ORDER = 5
BLOCK_BYTES = 16 << 20
# A discount is estimated inside these bounds: escapes never vanish, nor do symbols seen once.
DISCOUNTS = (0.1, 0.95)
_CHUNK = 1 << 21


def _cells(text: bytes, order: int) -> np.ndarray:
    """The (context, symbol) cell of every byte and of the end; modulo 257**k, of contexts of k - 1 bytes."""
    symbols = np.empty(len(text) + order + 1, dtype=np.int64)
    symbols[:order] = END
    symbols[order:-1] = np.frombuffer(text, dtype=np.uint8)
    symbols[-1] = END
    cells = np.zeros(len(text) + 1, dtype=np.int64)
    for i in range(order + 1):
        cells *= SYMBOLS
        cells += symbols[i : i + len(cells)]
    return cells


def _merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct cells with counts as one; a stable sort merges two sorted runs in one go."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    both = both[order]
    starts = np.flatnonzero(np.diff(both, prepend=both[0] - 1))
    return both[starts], np.add.reduceat(np.concatenate([n, m])[order], starts)


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of some texts and their counts, holding a few million cells at a time."""
    cells, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(_cells(text, order))
        size += len(held[-1])
        if size >= _CHUNK or i == len(texts) - 1:
            new, n = np.unique(np.concatenate(held), return_counts=True)
            cells, counts = _merged(cells, counts, new, n) if len(cells) else (new, n)
            held, size = [], 0
    return cells, counts


# The end of a text as a token: no word holds white space.
_END_TOKEN = b" "


def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), _END_TOKEN]


# In place of a cell, where a row is about a word.
_A_WORD = -1
ASKED = "block int, word binary, cell long, n long"


def _asks(order: int):
    """One block's distinct words and cells with their counts in its training texts."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        number, out = int(block["block"].iloc[0]), block["held_out"].to_numpy()
        texts = block["text"].to_numpy()
        trained, others = Counter(), set()
        for text in texts[~out]:
            trained.update(_tokens(text))
        for text in texts[out]:
            others.update(_tokens(text))
        for word in others - trained.keys():
            trained[word] = 0
        words = pd.DataFrame({"word": list(trained), "n": list(trained.values())})
        cells, n = _distinct(list(texts[~out]), order)
        more, _ = _distinct(list(texts[out]), order)
        more = np.setdiff1d(more, cells, assume_unique=True)
        cells, n = np.concatenate([cells, more]), np.concatenate([n, np.zeros(len(more), dtype=np.int64)])
        found = pd.DataFrame({"cell": cells, "n": n})
        names = ["block", "word", "cell", "n"]
        return pd.concat([words.assign(cell=_A_WORD), found.assign(word=None)]).assign(block=number)[names]

    return run


def trie_levels(cells: DataFrame, order: int) -> list[DataFrame]:
    """(cell, n) of every level, the empty context first, from the deepest: ``cells`` (cell, n) in any multiplicity."""
    levels = [stored(cells.groupBy("cell").agg(F.sum("n").alias("n")), f"level-{order}", "zstd")]
    for k in range(order, 0, -1):
        suffix = F.pmod(F.col("cell"), F.lit(SYMBOLS**k)).alias("cell")
        seen = F.sum((F.col("n") > 0).cast("long")).alias("n")
        levels.append(stored(levels[-1].groupBy(suffix).agg(seen), f"level-{k - 1}", "zstd"))
    return levels[::-1]


def _discount(level: DataFrame) -> float:
    """The share of a count that escapes, from the cells seen once and twice."""
    once, twice = level.agg(
        F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")
    ).first()
    return min(max(once / (once + 2 * twice), DISCOUNTS[0]), DISCOUNTS[1]) if once + twice else 0.5


def cell_probabilities(levels: list[DataFrame]) -> DataFrame:
    """(cell, p) of the deepest level: probability of the symbol after the context, escapes and exclusions worked out.

    Per level a row carries p, and ``below``: the probability of its symbol in the context shorter by a byte if
    the symbols its own context has seen are excluded.
    """
    context = Window.partitionBy("context")
    table, share1 = None, 0.0
    for k, level in enumerate(levels):
        share = _discount(level)
        own = level.withColumn("context", F.expr(f"cell div {SYMBOLS}"))
        if k:
            own = own.withColumn("suffix", F.pmod(F.col("cell"), F.lit(SYMBOLS**k))).join(table, "suffix")
        seen = F.col("n") > 0
        sums = {"total": F.sum("n").over(context), "kinds": F.sum(seen.cast("long")).over(context)}
        if k:
            sums["taken"] = F.sum(F.when(seen, F.col("n1")).otherwise(0)).over(context)
        own = own.withColumns(sums)
        if k:
            left, new = F.col("total1") - F.col("taken"), F.col("kinds1") - F.col("kinds")
            found, escape = _shares(F.col("n1"), left, new, F.col("kinds1"), share1)
            below = F.when(F.col("n1") > 0, found).otherwise(escape * F.col("below1"))
            shorter = F.col("p1")
        else:
            below = 1.0 / F.greatest(F.lit(SYMBOLS) - F.col("kinds"), F.lit(1))
            shorter = F.lit(1.0 / SYMBOLS)
        own = own.withColumn("below", below)
        found, escape = _shares(F.col("n"), F.col("total"), F.col("kinds"), F.col("kinds"), share)
        unseen = F.when(F.col("total") > 0, escape * F.col("below")).otherwise(shorter)
        own = own.withColumn("p", F.when(seen, found).otherwise(unseen))
        names = ("n", "total", "kinds", "below", "p")
        table = own.select(F.col("cell").alias("suffix"), *[F.col(c).alias(f"{c}1") for c in names])
        share1 = share
    return table.select(F.col("suffix").alias("cell"), F.col("p1").alias("p"))


def _shares(n: Column, total: Column, kinds: Column, all_kinds: Column, share: float) -> tuple[Column, Column]:
    """Probability of a symbol seen n times, and of an escape: 1 where nothing is left to be seen.

    A context that has seen all symbols keeps nothing back for an escape.
    """
    kept = F.when(all_kinds < SYMBOLS, F.lit(share)).otherwise(0.0)
    whole = F.greatest(total, F.lit(1))
    return (n - kept) / whole, F.when(total > 0, kept * kinds / whole).otherwise(1.0)


SCORED = "n_tokens long, n_known long, known double, score double"


def _scores(order: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "held_out", "n_tokens", "n_known", "known", "score"]
        if not len(left):
            return pd.DataFrame({name: [] for name in names})
        cells, found = right["cell"].to_numpy(), right["log"].to_numpy()
        is_word = cells == _A_WORD
        words = right[is_word]
        logs = dict(zip(words["word"], words["log"].tolist(), strict=True))
        cells, found = cells[~is_word], found[~is_word]
        by_cell = np.argsort(cells)
        cells, found = cells[by_cell], found[by_cell]
        rows = []
        for text in left["text"]:
            tokens = _tokens(text)
            hits = [logs[t] for t in tokens if t in logs]
            # Sorted, since neighbours are then found in neighbouring places of a long list.
            held = np.sort(_cells(text, order))
            score = sum(
                float(found[np.searchsorted(cells, held[i : i + _CHUNK])].sum()) for i in range(0, len(held), _CHUNK)
            )
            rows.append((len(tokens), len(hits), sum(hits) - (len(tokens) - len(hits)), score))
        scored = pd.DataFrame(rows, columns=names[2:])
        return pd.concat([left[["id", "held_out"]].reset_index(drop=True), scored], axis=1)

    return run


def score_documents(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    order: int = ORDER,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` says of each row of ``docs`` whether it is kept from training; ``order``, from 1 to 6, is the
    number of bytes of the longest context.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must lie between 1 and 6")
    body = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(n_bytes(F.col(text)) + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # Rows, not ids, are dealt: a text longer than a block lies alone or with few others.
    rows = docs.select(
        F.col(key).alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        body.cast("binary").alias("text"),
        F.pmod(F.xxhash64(F.lit(71), F.col(key), body), F.lit(blocks)).cast("int").alias("block"),
    )
    asked = stored(rows.groupBy("block").applyInPandas(_asks(order), ASKED), "asked", "zstd")
    words, cells = asked.where(F.col("cell") == _A_WORD), asked.where(F.col("cell") != _A_WORD)
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    size = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("train_tokens"), F.count("*").alias("vocabulary")
    )
    table = cell_probabilities(trie_levels(cells.select("cell", "n"), order))
    answered = (
        words.select("block", "word")
        .join(counts, "word")
        .select("block", "word", F.lit(_A_WORD).cast("long").alias("cell"), F.log10(F.col("c") + 0.1).alias("log"))
        .unionByName(
            cells.select("block", "cell")
            .join(table, "cell")
            .select("block", F.lit(None).cast("binary").alias("word"), "cell", F.log10("p").alias("log"))
        )
    )
    kind = rows.schema["id"].dataType.simpleString()
    scored = (
        rows.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInPandas(_scores(order), f"id {kind}, held_out boolean, {SCORED}")
    )
    # One row, whatever the corpus.
    share = F.log10(F.col("train_tokens") + 0.1 * (F.col("vocabulary") + 1))
    return scored.join(F.broadcast(size)).select(
        "id",
        "held_out",
        "n_tokens",
        "n_known",
        "train_tokens",
        (F.col("known") - F.col("n_tokens") * share).alias("base_score"),
        "score",
    )


def held_out_rows(key: Column, modulus: int = 10, remainder: int = 0) -> Column:
    return id_remainder(key, modulus) == remainder
