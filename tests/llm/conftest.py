from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASH = ", id string, size string, component string, value string, n string, block string, digest string"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture
def documents(spark):
    """``documents(texts)``: a table of documents, with columns of clashing names on request."""

    def make(texts, clash=False, ids=None, sources=None, partitions=3):
        ids = range(len(texts)) if ids is None else ids
        sources = [f"src{i % 3}" for i in range(len(texts))] if sources is None else sources
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)]
        if clash:
            rows = [(*r, *["x"] * 7) for r in rows]
        return spark.createDataFrame(rows, DOCS + (CLASH if clash else "")).repartition(partitions)

    return make


@pytest.fixture
def mixed_texts():
    """Nulls, blanks, ties, copies, near copies, short and very long texts."""
    base = words(1, 120)
    changed = base.split()
    changed[7] = "other"
    near = " ".join(changed)
    return [
        None, "", "   \n\t", "one", "ONE", "one two three four", "one two three four", base, base, near,
        base.upper(), base.replace(" ", "\n\n "), words(2, 300), words(3, 30_000), words(3, 30_000) + " end",
        "é" * 40, words(4, 5), words(5, 64), "\x00 \x1f x", words(2, 300) + " " + words(6, 20),
    ]
