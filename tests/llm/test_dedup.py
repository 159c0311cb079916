"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.llm import common, embedding_dedup, exact_dedup, minhash

from .conftest import words


def smallest_reachable(ids, links):
    seen = {i: i for i in ids}

    def root(i):
        while seen[i] != i:
            seen[i] = seen[seen[i]]
            i = seen[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        seen[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(
    "links",
    [
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 200)],
        [(200 - i, 199 - i) for i in range(0, 200, 2)] + [(5, 150), (150, 151)],
        [(3, 3)],
        [],
    ],
)
def test_components(spark, links):
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    expected = smallest_reachable(nodes, [x for x in links if x[0] != x[1]])
    assert got == expected


def test_numbered_slots_have_no_gaps(spark):
    rows = [("hot" if i % 3 else None, i // 2) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    got = common.numbered(df, ["g"], "k", "slot", per_bucket=50).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["slot"]) == list(range(len(part)))


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {
        i: (min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    }


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_exact_groups(documents, mixed_texts, support):
    texts = mixed_texts + ["copy of\tall"] * 40 + ["copy  of all"] * 20
    random.Random(2).shuffle(texts)
    got = exact_dedup.exact_groups(documents(texts, clash=True), support=support).collect()
    assert {r.id: (r.keep, r.group_size, r.digest) for r in got} == brute_exact(enumerate(texts))
    assert len(got) == len(texts)


def test_exact_winners_are_verified(documents):
    docs = documents(["a"] * 50 + ["b"] * 30 + [str(i) for i in range(20)])
    digests = docs.select(F.col("doc_id").alias("id"), exact_dedup.normalised_sha256(F.col("text")).alias("digest"))
    found = {r.group_size for r in exact_dedup.frequent_digests(digests, 0.25).collect()}
    assert found == {50, 30}


def test_exact_edges(documents):
    assert exact_dedup.exact_groups(documents([])).collect() == []
    docs = documents(["a", "a", None, "b"], ids=[None, 4, None, None])
    kept = exact_dedup.drop_exact_copies(docs)
    assert sorted((r.doc_id is None, r.text or "") for r in kept.collect()) == [
        (False, "a"), (True, ""), (True, "a"), (True, "b"),
    ]
    assert kept.columns == docs.columns
    twice = documents(["a", "a"], ids=[1, 1])
    assert exact_dedup.drop_exact_copies(twice).count() == 2


def test_exact_main_path_has_no_python(documents):
    plan = exact_dedup.exact_groups(documents(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingle_set(text):
    found = (text or "").encode().lower().split()
    if not found:
        return set()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def brute_near(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = list(sets)
    links = []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                if 100 * len(a & b) >= 75 * len(a | b):
                    links.append((i, j))
    reach = smallest_reachable(ids, links)
    return {i: (len(sets[i]), reach[i]) for i in ids}


def near_corpus():
    """A family with a chain of drifting copies, many copies of one text, and a passage many share."""
    draw = random.Random(9)
    texts = []
    passage = words(50, 60)
    for i in range(40):
        texts.append(words(100 + i, 25) + " " + passage)
    drifting = words(51, 150).split()
    for i in range(30):
        drifting = list(drifting)
        for _ in range(2):
            drifting[draw.randrange(len(drifting))] = f"w{i}{draw.random()}"
        texts.append(" ".join(drifting))
    base = words(52, 200).split()
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = f"v{i}{draw.random()}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 30
    draw.shuffle(texts)
    return texts


def test_near_duplicates(documents, mixed_texts):
    texts = mixed_texts + near_corpus()
    got = minhash.near_duplicates(documents(texts, clash=True)).collect()
    assert len(got) == len(texts)
    assert {r.id: (r.n_shingles, r.component) for r in got} == brute_near(list(enumerate(texts)))


def test_long_lists_give_the_links_of_short_ones(documents):
    texts = near_corpus()
    docs = documents(texts)
    sets = minhash.shingle_sets(docs.select(F.col("doc_id").alias("id"), "text"))
    signed = minhash.signatures(docs).where("n > 0")
    lists = signed.select(F.explode("signature").alias("value"), "id", "n", F.col("id").alias("part"), "codes")
    found = [
        {tuple(r) for r in minhash.links_between_parts(lists, sets, *limits).collect()}
        for limits in ((10**6,), (0, 16), (5, 512, 3000), (0, 10**6, 10**9))
    ]
    exact = [shingle_set(t) for t in texts]
    near = {
        (i, j)
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if 100 * len(exact[i] & exact[j]) >= 75 * len(exact[i] | exact[j])
    }
    assert found[0] == found[1] == found[2] == found[3] == near and len(near) > 500


def test_near_edges(documents):
    assert minhash.near_duplicates(documents([])).collect() == []
    docs = documents(["x y", "x y", "X  y", None], ids=[None, 5, 3, None])
    got = sorted((r.id or -1, r.n_shingles, r.component or -1) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, 0, -1), (-1, 1, -1), (3, 1, 3), (5, 1, 3)]
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_codes_count_every_match():
    a, b = minhash._multipliers()
    one = minhash.signature(np.arange(1, 200, dtype=np.uint64), a, b)
    other = minhash.signature(np.arange(20, 220, dtype=np.uint64), a, b)
    assert len(set(one) & set(other)) == (one == other).sum()


def brute_vectors(rows):
    usable = {
        i: (label, np.array(v, dtype=float))
        for i, v, label in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    }
    links, counts = [], {i: 0 for i, _, _ in rows}
    for i, (li, vi) in usable.items():
        for j, (lj, vj) in usable.items():
            if i < j and li == lj and len(vi) == len(vj):
                if vi @ vj / np.linalg.norm(vi) / np.linalg.norm(vj) >= 0.93:
                    links.append((i, j))
                    counts[i] += 1
                    counts[j] += 1
    reach = smallest_reachable(list(counts), links)
    return {i: (counts[i], reach[i]) for i in counts}


@pytest.mark.parametrize("block", [7, 1024])
def test_near_vectors(spark, block):
    draw = np.random.default_rng(4)
    rows = []
    for centre in draw.normal(size=(6, 16)):
        for _ in range(25):
            rows.append((centre + draw.normal(size=16) * 0.25).tolist())
    rows += [rows[0], [x * 3 for x in rows[1]], [0.0] * 16, [-0.0] * 16, None, [], [1.0, None] + [0.0] * 14]
    rows += [[float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e-30] * 16, [1e30] * 16, [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v, None if i % 17 == 0 else i % 2) for i, v in enumerate(rows)]
    df = spark.createDataFrame(
        [(*r, "x", "y") for r in table], "vec_id long, embedding array<double>, label int, id string, class string"
    )
    got = embedding_dedup.near_vectors(df.repartition(3), block=block).collect()
    assert {r.id: (r.n_links, r.component) for r in got} == brute_vectors(table)
    assert len(got) == len(table)
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_quantisation_bound_is_rigorous():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, coded, error = embedding_dedup.quantise(x)
    approximate = (codes.astype(float) @ codes.astype(float).T) * np.outer(scale, scale)
    bound = np.outer(coded, error) + np.outer(error, coded) + np.outer(error, error)
    assert (np.abs(approximate - x @ x.T) <= bound + 1e-12).all()
