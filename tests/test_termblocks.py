"""Lookups by blocks of texts: the same rows as by hand, whatever the blocks, and no row per text and term shuffled."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from auditlens.functions.text import tokens_ws
from auditlens.operators import termblocks, tfidf, vocabulary

ROWS = [
    (1, "grep alpha beta alpha", 0),
    (2, "beta gamma", 1),
    (2, "delta beta beta", 0),
    (None, "alpha delta", 1),
    (None, "gamma", 1),
    (3, None, 0),
    (4, "", 1),
    (5, "omega unseen", 0),
]
SCHEMA = "cmd_id long, command string, label int"


@pytest.fixture(params=[8, 1 << 20])
def block_chars(request, monkeypatch):
    """Many blocks, and texts of one block, which are joined plainly."""
    monkeypatch.setattr(termblocks, "BLOCK_CHARS", request.param)
    return request.param


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffled_rows_are_asked_once(df) -> None:
    found = plan(df)
    assert "FlatMapCoGroupsInArrow" in found
    # What is joined comes from the stored terms of blocks, not from the texts.
    assert re.search(r"Generate posexplode\(terms", found)


def weights(rows, idf):
    """(id, label, term, weight) by hand."""
    counts = [(i, label, Counter(re.findall(r"\w{2,}", (text or "").lower()))) for i, text, label in rows]
    squares = defaultdict(float)
    for i, _, terms in counts:
        squares[i] += sum((n * idf[t]) ** 2 for t, n in terms.items() if t in idf)
    return sorted(
        (str(i), label, t, round(n * idf[t] / math.sqrt(squares[i]), 9))
        for i, label, terms in counts
        for t, n in terms.items()
        if t in idf
    )


def test_weights_by_blocks(frame, block_chars):
    df = frame(ROWS, SCHEMA)
    model = tfidf.tfidf_fit(df.where("coalesce(cmd_id, 0) < 5"))
    idf = {r.term: r.idf for r in model.terms.collect()}
    got = tfidf.tfidf_transform(df, model, keep=("label",))
    if block_chars == 8:
        shuffled_rows_are_asked_once(got)
        assert "Window" not in plan(got)
    assert got.columns == ["cmd_id", "label", "term", "weight"]
    assert sorted((str(r.cmd_id), r.label, r.term, round(r.weight, 9)) for r in got.collect()) == weights(ROWS, idf)


def test_vectors_by_blocks(frame, block_chars):
    df = frame([*ROWS, (2, "beta beta", 1)], SCHEMA)
    model = tfidf.tfidf_fit(df.where("coalesce(cmd_id, 0) < 5"))
    idf = {r.term: r.idf for r in model.terms.collect()}
    got = tfidf.tfidf_vectors(df, model, keep=("label",))
    assert got.columns == ["cmd_id", "label", "vector"]
    if block_chars == 8:
        shuffled_rows_are_asked_once(got)
    want = {}
    for i, text, label in [*ROWS, (2, "beta beta", 1)]:
        counts = Counter(re.findall(r"\w{2,}", (text or "").lower()))
        want.setdefault((str(i), label), []).extend((t, n * idf[t]) for t, n in counts.items() if t in idf)
    for entries in want.values():
        norm = math.sqrt(sum(x * x for _, x in entries))
        entries[:] = [(t, round(x / norm, 9)) for t, x in sorted(entries)]
    assert {(str(r.cmd_id), r.label): [(e.term, round(e.weight, 9)) for e in r.vector] for r in got.collect()} == want


def test_scores_by_blocks(frame, block_chars):
    df = frame(ROWS, SCHEMA)
    terms = tfidf.tfidf_fit(df.where("coalesce(cmd_id, 0) < 5")).terms.selectExpr("term", "idf", "length(term) * idf as size")
    known = {r.term: (r.idf, r.size) for r in terms.collect()}
    got = tfidf.term_scores(df, terms, ("size",), keep=("label",))
    assert ("posexplode(terms" in plan(got)) == (block_chars == 8)
    sums = {}
    for i, text, label in ROWS:
        total = sums.setdefault((i, label), [0.0, 0.0])
        for t, n in Counter(re.findall(r"\w{2,}", (text or "").lower())).items():
            idf, size = known.get(t, (0.0, 0.0))
            total[0] += (n * idf) ** 2
            total[1] += n * idf * size
    expected = {k: (math.sqrt(s), d / math.sqrt(s) if s else 0.0) for k, (s, d) in sums.items()}
    found = {(r.cmd_id, r.label): (r["norm"], r["size"]) for r in got.collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in expected)


def test_codes_by_blocks(frame, block_chars):
    df = frame(ROWS, SCHEMA)
    words = vocabulary.build_vocabulary(df.where("coalesce(cmd_id, 0) < 5"), tokens_ws)
    ids = {r.token: r.token_id for r in words.collect()}
    got = vocabulary.encode(df, words, tokens_ws)
    if block_chars == 8:
        shuffled_rows_are_asked_once(got)
    placed = defaultdict(list)
    for i, text, _ in ROWS:
        placed[i] += [(at, ids.get(t, -1)) for at, t in enumerate((text or "").split())]
    assert {r.cmd_id: r.ids for r in got.collect()} == {i: [n for _, n in sorted(p)] for i, p in placed.items()}
    assert got.count() == len(placed)


def test_no_texts(frame, block_chars):
    none = frame(ROWS, SCHEMA).where("cmd_id = 99")
    model = tfidf.tfidf_fit(frame(ROWS, SCHEMA))
    assert tfidf.tfidf_transform(none, model).count() == 0
    assert vocabulary.encode(none, vocabulary.build_vocabulary(none, tokens_ws), tokens_ws).count() == 0
