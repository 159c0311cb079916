from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditlens.operators import setjoin

SCHEMA = "id long, tokens array<string>, size int"


def rows(lists):
    return [(i, list(dict.fromkeys(t)), len(t)) for i, t in enumerate(lists)]


def nearest(queries, references, normalised):
    found = {}
    for q, a, n in queries:
        fractions = [
            (n + m - 2 * len(set(a) & set(b)), n + m if normalised else 1) for _, b, m in references if n and m
        ]
        if fractions:
            found[q] = min((x / y, x, y) for x, y in fractions)[1:]
    return found


def draws(seed, n, words, longest):
    draw = random.Random(seed)
    return [[f"t{int(words * draw.random() ** 3)}" for _ in range(draw.randint(0, longest))] for _ in range(n)]


@pytest.mark.parametrize("normalised", [True, False])
@pytest.mark.parametrize("words,longest", [(8, 6), (60, 25), (2000, 40)])
def test_nearest_sets_equal_all_pairs(frame, normalised, words, longest):
    queries = rows([*draws(words, 50, words, longest), ["unknown"], ["t0"] * 30, []])
    # A third of the references are equal, and one token is on most of them.
    many = draws(words + 1, 60, words, longest)
    references = rows([*many, *[["t0", "t1", "t1"]] * 40, *[["t0", *t] for t in many[:20]]])
    got = setjoin.nearest_sets(frame(queries, SCHEMA), frame(references, SCHEMA), normalised).collect()
    assert {r.id: (r.numerator, r.denominator) for r in got} == nearest(queries, references, normalised)


def test_nothing_to_compare(frame):
    some, none = frame(rows([["a"], ["b", "c"]]), SCHEMA), frame(rows([[], []]), SCHEMA)
    assert setjoin.nearest_sets(some, none).count() == 0
    assert setjoin.nearest_sets(none, some).count() == 0
    assert setjoin.nearest_sets(some.limit(0), some).count() == 0
    assert setjoin.nearest_sets(some, some.limit(0)).count() == 0


def test_bounds_keep_most_pairs_apart(frame, monkeypatch):
    """Copies with one word changed share 20 frequent words with everything, but meet only what is near."""
    draw = random.Random(3)
    common = [f"c{i}" for i in range(20)]
    base = [[*common, *(f"r{i}_{k}" for k in range(20))] for i in range(300)]
    changed = [[w if draw.random() > 0.05 else "other" for w in t] for t in base]
    queries, references = rows(changed), rows(base)
    met = []
    plain = setjoin.candidate_pairs

    def counting(*args):
        met.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(setjoin, "candidate_pairs", counting)
    got = setjoin.nearest_sets(frame(queries, SCHEMA), frame(references, SCHEMA)).collect()
    assert {r.id: (r.numerator, r.denominator) for r in got} == nearest(queries, references, True)
    assert met[0] < 2 * len(queries) < len(queries) * len(references) / 100


def test_no_pair_product_in_the_plan(frame):
    df = frame(rows(draws(1, 30, 20, 8)), SCHEMA)
    known = df.select("id", "size", F.array(F.lit(1).cast("bigint")).alias("known"))
    bounded = known.withColumns({"num": F.lit(3).cast("bigint"), "den": F.lit(5).cast("bigint")})
    plan = setjoin.candidate_pairs(bounded, known, True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
