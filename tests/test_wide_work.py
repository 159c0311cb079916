"""Work that must grow no faster than its input: passes over rows, rows made anew, rows copied for a comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector

from auditlens.operators import projection, reduction


def test_svd_of_few_columns_is_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(120, 25)) * np.linspace(4, 0.5, 25) + 0.3
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "x array<double>").repartition(4)
    df = rows.select(array_to_vector("x").alias("features"))
    with monkeypatch.context() as forbidden:
        forbidden.setattr(reduction, "cut_lineage", lambda df: pytest.fail("rows are stored"))
        forbidden.setattr(reduction, "_gram_times", lambda *a: pytest.fail("a further pass"))
        one = reduction.truncated_svd(df, 5)
    monkeypatch.setattr(reduction, "GRAM_COLUMNS", 10)
    many = reduction.truncated_svd(df, 5, tolerance=1e-9)
    _, s, _ = np.linalg.svd(points, full_matrices=False)
    for model in (one, many):
        assert model.singular == pytest.approx(s[:5], rel=1e-6)
    assert one.components == pytest.approx(many.components, abs=1e-5)
    assert one.ratio == pytest.approx(many.ratio, abs=1e-6) and one.variance == pytest.approx(many.variance, abs=1e-5)


def test_rows_of_frequent_terms_are_made_once(monkeypatch):
    """Many rare terms come first: the terms every text holds still keep their rows."""
    monkeypatch.setattr(projection, "CACHE_BYTES", 4 * 16 * 10)
    monkeypatch.setattr(projection, "BLOCK", 16 * 20)
    texts = [[f"rare{i}_{j}" for j in range(12)] + [f"common{j}" for j in range(8)] for i in range(50)]
    made = []
    plain = projection.TermRows.made
    monkeypatch.setattr(projection.TermRows, "made", lambda self, term: made.append(term) or plain(self, term))
    source = projection.TermRows(16, 3)
    weights = np.arange(1000) / 100
    got = source.project(pa.array([t for text in texts for t in text]), weights, np.array([20] * 50))
    assert made.count("common0") == 1 and len(made) == 50 * 12 + 8
    fresh = projection.TermRows(16, 3)
    want = [sum(weights[20 * i + j] * plain(fresh, t).astype(float) for j, t in enumerate(text)) for i, text in enumerate(texts)]
    assert got == pytest.approx(np.array(want), abs=1e-9)


def test_far_more_cells_than_blocks_copy_each_side_once_per_piece(frame, monkeypatch):
    """All rows equally far apart, in many cells: nothing can be skipped, but small cells share blocks and pieces."""
    from auditlens.operators import cells, neighbours

    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 48))
    df = frame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
    dealt = []
    plain = cells._pieces

    def counted(*args):
        first, parts = plain(*args)
        dealt.append((len({n for f, k in zip(first, parts) for n in range(f, f + k)}), sum(k > 0 for k in parts)))
        return first, parts

    monkeypatch.setattr(cells, "_pieces", counted)
    row = 48 * 8 + 512
    near = neighbours.k_nearest(df, df, 3, skip_self=True, block_bytes=100 * row).collect()
    (blocks, filled), (pieces, _) = dealt
    assert filled > 40 and blocks <= 8 and pieces <= 70
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(gaps[i])[:3]}
    assert {(r["id"], r["neighbour"]) for r in near} == want


def test_sets_without_close_references_emit_few_pairs(frame, monkeypatch):
    """Every reference shares frequent tokens with every query: no pairs are made, blocks are compared."""
    import random

    from auditlens.operators import setjoin

    draw = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, t, len(t)) for i in range(150) for t in [draw.sample(words, draw.randint(5, 20))]]
    made = []
    plain = setjoin.candidate_pairs
    monkeypatch.setattr(setjoin, "candidate_pairs", lambda *a: made.append(plain(*a).count()) or plain(*a))
    schema = "id long, tokens array<string>, size int"
    got = setjoin.nearest_sets(frame(rows[:60], schema), frame(rows[60:], schema)).collect()
    assert made[0] <= 60 * setjoin.NARROW * setjoin.RARE / 10
    for r in got:
        a = set(rows[r["id"]][1])
        best = min((len(a) + n - 2 * len(a & set(t))) / (len(a) + n) for _, t, n in rows[60:])
        assert r["numerator"] / r["denominator"] == pytest.approx(best, abs=1e-12)
    assert len(got) == 60


def test_a_rare_term_row_is_made_once_per_batch(monkeypatch):
    """Terms beyond the kept rows are made once, however many blocks of texts hold them."""
    monkeypatch.setattr(projection, "CACHE_BYTES", 2 * 4 * 16)
    monkeypatch.setattr(projection, "BLOCK", 16 * 4)
    made = []
    plain = projection.TermRows.made
    monkeypatch.setattr(projection.TermRows, "made", lambda self, term: made.append(term) or plain(self, term))
    texts = [["a", "b", f"t{i % 5}", f"t{(i + 1) % 5}"] for i in range(20)] + [[]]
    weights = np.arange(1.0, 81.0)
    found = projection.TermRows(16, 3).project(
        pa.array([t for text in texts for t in text]), weights, np.array([len(t) for t in texts])
    )
    assert sorted(made) == ["a", "b", "t0", "t1", "t2", "t3", "t4"]
    rows = projection.TermRows(16, 3)
    for i, text in enumerate(texts):
        want = sum((w * plain(rows, t).astype(float) for t, w in zip(text, weights[4 * i :])), np.zeros(16))
        assert found[i] == pytest.approx(want)
    often = projection.TermRows(16, 3).project(pa.array(["a", "a"]), np.ones(2), np.array([1, 0, 1]))
    assert often[1].tolist() == [0.0] * 16 and often[0] == pytest.approx(plain(rows, "a").astype(float))


def zipf_sets(seed, n, words=300):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    return [np.unique(rng.choice(words, rng.integers(1, 60), p=share / share.sum())).tolist() for _ in range(n)]


@pytest.mark.parametrize("normalised", [True, False])
def test_frequent_tokens_are_multiplied_not_looked_up(monkeypatch, normalised):
    """Tokens that much of both sides holds are columns of a matrix; distances stay exact, over several tiles."""
    from auditlens.operators import scanners

    monkeypatch.setattr(scanners, "QUERIES", 16)
    monkeypatch.setattr(scanners, "CELLS", 200)
    queries, references = zipf_sets(1, 50), zipf_sets(2, 90)

    def side(sets):
        columns = [pa.array(range(len(sets))), pa.array(sets, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32())]
        return pa.table(columns, names=["id", "tokens", "size"])

    scanner = scanners.NearestOverlap(side(queries), normalised)
    expanded, plain = [], np.add.at
    monkeypatch.setattr(scanners.np, "add", type("Add", (), {"at": lambda a, i, v: expanded.append(len(i)) or plain(a, i, v)}))
    for batch in side(references).to_batches(max_chunksize=40):
        scanner.feed(batch)
    shared = sum(len(set(a) & set(b)) for a in queries for b in references)
    assert sum(expanded) < shared / 3
    found = scanner.finish().to_pylist()
    assert [r["id"] for r in found] == list(range(50))
    for r, a in zip(found, queries):
        gaps = [(len(a) + len(b) - 2 * len(set(a) & set(b)), len(a) + len(b) if normalised else 1) for b in references]
        assert (r["numerator"], r["denominator"]) == min(gaps, key=lambda g: (g[0] / g[1], g[1], g[0]))


def test_nearest_vectors_are_selected_once_and_then_compared(monkeypatch):
    """Once a query knows k references, further ones only meet its limit; single precision decides nothing."""
    from auditlens.operators import scanners

    monkeypatch.setattr(scanners, "QUERIES", 25)
    monkeypatch.setattr(scanners, "CELLS", 25 * 30)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 6))
    points[300:320] = points[:20] + 1e-7 * rng.normal(size=(20, 6))
    table = pa.table({"id": pa.array(range(600)), "features": pa.array(points.tolist()), "label": pa.array([0] * 600, pa.int32())})
    calls, plain = [], np.partition
    monkeypatch.setattr(scanners.np, "partition", lambda *a, **b: calls.append(1) or plain(*a, **b))
    scanner = scanners.KNearest(table.slice(0, 50).drop(["label"]), 4, False, 9, True)
    for batch in table.to_batches(max_chunksize=100):
        scanner.feed(batch)
    assert len(calls) <= 2
    gaps = np.sqrt(((points[:50, None] - points[None]) ** 2).sum(-1))
    gaps[np.arange(50), np.arange(50)] = np.inf
    found = {(r["id"], r["neighbour"]): r["distance"] for r in scanner.finish().to_pylist()}
    assert set(found) == {(i, int(j)) for i in range(50) for j in np.argsort(gaps[i], kind="stable")[:4]}
    assert all(d == pytest.approx(gaps[i, j], rel=1e-9) for (i, j), d in found.items())


def test_text_references_are_stored_once_for_all_blocks_of_queries(frame, monkeypatch):
    """Many blocks of queries: the references are neither shuffled nor copied again for each."""
    import random

    from auditlens.operators import blockjoin, neighbours, tfidf

    draw = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(draw.choice(words[: 10 ** (1 + i % 2) * 2]) for _ in range(draw.randint(0, 25))) for i in range(150)]
    df = frame([(i, t, i % 2) for i, t in enumerate(texts + texts[:30])], "cmd_id long, command string, label int")
    vectors = tfidf.tfidf_vectors(df, tfidf.tfidf_fit(df), keep=("label",))
    kept, rounds, plain = [], [], blockjoin.stored
    monkeypatch.setattr(blockjoin, "stored", lambda df, name, *a: kept.append(name) or rounds.append(df) or plain(df, name, *a))
    monkeypatch.setattr(blockjoin, "PACKED_BYTES", 4000)
    near = neighbours.k_nearest(vectors, vectors, 4, "cmd_id", "label", skip_self=True, block_bytes=20_000).collect()
    assert kept.count("references") == 1 and kept.count("answers") >= 4
    plans = [d._jdf.queryExecution().executedPlan().toString() for d, name in zip(rounds, kept) if name == "answers"]
    assert all("CoGroup" not in p for p in plans)
    monkeypatch.undo()
    whole = neighbours.k_nearest(vectors, vectors, 4, "cmd_id", "label", skip_self=True).collect()
    row = lambda r: (r["cmd_id"], r["rank"], r["neighbour"], r["label"], round(r["distance"], 5))
    assert sorted(map(row, near)) == sorted(map(row, whole)) and len(near) == 180 * 4


def test_large_sides_get_larger_blocks(frame, monkeypatch):
    """Each side is copied once per block of the other: their number does not grow with both sides."""
    from auditlens.operators import cells, neighbours

    points = np.random.default_rng(5).normal(size=(400, 48))
    df = frame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
    dealt, plain = [], cells._pieces
    monkeypatch.setattr(cells, "_pieces", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    monkeypatch.setattr(cells, "GROWS_FROM", 50 * (48 * 8 + 512))
    near = neighbours.k_nearest(df, df, 3, skip_self=True, block_bytes=20 * (48 * 8 + 512)).collect()
    assert all(max(f + n for f, n in zip(first, parts)) <= 14 for first, parts in dealt)
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    assert {(r["id"], r["neighbour"]) for r in near} == {(i, int(j)) for i in range(400) for j in np.argsort(gaps[i])[:3]}
