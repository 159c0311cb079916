from __future__ import annotations

import collections
import math
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from auditlens.operators import classifiers, neighbours, quantile, tfidf
from auditlens.operators.bayes import bayes_fit, bayes_scores
from auditlens.operators.centroid import centroid_detector, centroid_distance, centroid_fit
from auditlens.operators.discriminant import discriminant_fit, lda_classify
from auditlens.operators.isolation import isolation_forest, tree_samples
from auditlens.operators.nearest import filter_by_distance, nearest_distance, nearest_scores
from auditlens.operators.oneclass import one_class_fit, one_class_score
from auditlens.operators.reduction import (
    SvdModel,
    direction_residuals,
    explained_variance,
    svd_transform,
    truncated_svd,
)

WORDS = ["ls", "-l", "cat", "/etc/passwd", "rm", "", "the", "the", "x", "sudo", "grep", "w1", "w2", "w3"]
CMD = "cmd_id long, command string, label int"


def make_commands(n, seed, start=0):
    rng = random.Random(seed)
    return [(start + i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))), rng.randrange(2)) for i in range(n)]


def gap(a, b):
    return len(a) + len(b) - 2 * len(set(a) & set(b))


@pytest.mark.parametrize("block_bytes", [10**7, 6000])
@pytest.mark.parametrize("normalised", [True, False])
def test_nearest_distance_is_exact(frame, block_bytes, normalised):
    """Both plans, the broadcast scan and the grid of blocks, agree with all pairs."""
    query, reference = make_commands(40, 1), make_commands(90, 2, 1000) + [(5000 + i, "the the", 0) for i in range(45)]
    got = nearest_distance(frame(query, CMD), frame(reference, CMD), normalised=normalised, block_bytes=block_bytes)
    found = {r["cmd_id"]: r["distance"] for r in got.collect()}
    for key, text, _ in query:
        a = text.split(" ")
        best = min(
            gap(a, b) / (len(a) + len(b) if normalised else 1) for b in (t.split(" ") for _, t, _ in reference)
        )
        assert found[key] == pytest.approx(best, abs=1e-12)
    assert len(found) == 40


def test_nearest_distance_edges(frame):
    query = frame([(1, "a a", 0), (2, "z", 0)], CMD)
    got = {r["cmd_id"]: r for r in nearest_distance(query, frame([(9, "a a", 0), (8, "b", 0)], CMD)).collect()}
    assert (got[1]["numerator"], got[1]["denominator"], got[1]["distance"]) == (2, 4, 0.5)
    assert got[2]["distance"] == 1.0
    empty = nearest_distance(query, query.where("false")).collect()
    assert {r["cmd_id"]: r["distance"] for r in empty} == {1: None, 2: None}
    assert nearest_distance(query.where("false"), query).count() == 0
    words = tfidf.tokens_word(F.col("command"))
    none = nearest_distance(frame([(1, "- -", 0), (2, "ab cd", 0)], CMD), frame([(9, "- ab", 0), (8, "-", 0)], CMD), tokens=words)
    assert {r["cmd_id"]: r["distance"] for r in none.collect()} == {1: None, 2: pytest.approx(1 / 3)}


def test_filter_by_distance(frame):
    base = frame([(1, "a b c", 0)], CMD)
    new = frame([(10, "a b", 0), (11, "x y z q", 0)], CMD)
    assert [r["cmd_id"] for r in filter_by_distance(new, base, 4).collect()] == [11]


def test_nearest_scores_follow_the_encoding(frame):
    """Empty tokens, tokens with other white space and unknown seed words are one token."""
    normals = frame([("ls  -l",), ("a\tb x",), ("top",)], "command string")
    abnormals = frame([("jstat",), ("q\tr zz",)], "command string")
    rows = nearest_scores(normals, abnormals, n=0)
    assert rows.count() == 0
    rows = {r["command"]: r["distance"] for r in nearest_scores(normals, abnormals.where("command <> 'jstat'"), n=1).collect()}
    assert set(rows) >= {"q\tr zz"}
    # "q<tab>r" is unknown, and so are the seeds grep, readlink and jstat: distance (2 + 1 - 2) / 3.
    assert rows["q\tr zz"] == pytest.approx(1 / 3)


def python_tfidf(fit, rows):
    split = lambda t: re.findall(r"\b\w\w+\b", t.lower())
    df = collections.Counter(t for text in fit for t in set(split(text)))
    idf = {t: math.log((1 + len(fit)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for text in rows:
        tf = collections.Counter(t for t in split(text) if t in idf)
        raw = {t: n * idf[t] for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append({t: x / norm for t, x in raw.items()})
    return out


def test_tfidf_matches_formula(frame):
    rows = make_commands(30, 4) + [(99, "- x", 0), (98, "Éa éa LS", 1)]
    fit = [r[1] for r in rows[:20]]
    model = tfidf.tfidf_fit(frame(rows[:20], CMD))
    vectors = {r["cmd_id"]: {e["term"]: e["weight"] for e in r["vector"]} for r in tfidf.tfidf_vectors(frame(rows, CMD), model).collect()}
    for (key, _, _), want in zip(rows, python_tfidf(fit, [r[1] for r in rows]), strict=True):
        assert vectors[key] == pytest.approx(want)
    assert vectors[99] == {}


def as_points(vectors):
    terms = sorted({t for v in vectors for t in v})
    return np.array([[v.get(t, 0.0) for t in terms] for v in vectors])


@pytest.mark.parametrize("block_bytes", [10**7, 9000])
def test_sparse_neighbours(frame, block_bytes):
    rows = make_commands(70, 7) + [(900 + i, "ls -l cat", 0) for i in range(30)]
    model = tfidf.tfidf_fit(frame(rows, CMD))
    vectors = tfidf.tfidf_vectors(frame(rows, CMD), model, keep=("label",))
    near = neighbours.k_nearest(vectors, vectors, 4, "cmd_id", "label", skip_self=True, block_bytes=block_bytes)
    got = collections.defaultdict(list)
    for r in near.orderBy("cmd_id", "rank").collect():
        got[r["cmd_id"]].append((r["neighbour"], round(r["distance"], 6)))
    points = as_points(python_tfidf([r[1] for r in rows], [r[1] for r in rows]))
    for i, (key, _, _) in enumerate(rows):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        want = sorted((round(d[j], 6), rows[j][0]) for j in range(len(rows)) if j != i)[:4]
        assert [n for n, _ in got[key]] == [k for _, k in want]
        assert [x for _, x in got[key]] == pytest.approx([x for x, _ in want], abs=2e-6)


def make_points(n, d, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, d))
    points[: n // 3] = points[0]  # a third of all rows are copies
    return points


VEC = "id long, features array<double>, label int"


@pytest.mark.parametrize("block_bytes", [10**7, 6000])
def test_dense_neighbours_and_outliers(frame, block_bytes):
    points = make_points(90, 5, 3)
    df = frame([(i, p.tolist(), i % 2) for i, p in enumerate(points)], VEC)
    near = neighbours.k_nearest(df, df, 6, skip_self=True, block_bytes=block_bytes).collect()
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in near}
    lists, k = {}, 6
    for i in range(90):
        order = sorted((round(distance[i, j], 9), j) for j in range(90) if j != i)[:k]
        lists[i] = [j for _, j in order]
        assert [got[i, n + 1][0] for n in range(k)] == lists[i]
        assert [got[i, n + 1][1] for n in range(k)] == pytest.approx([distance[i, j] for j in lists[i]], abs=1e-9)
    radius = {i: max(distance[i, j] for j in lists[i]) for i in range(90)}
    lrd = {i: 1 / (np.mean([max(distance[i, j], radius[j]) for j in lists[i]]) + 1e-10) for i in range(90)}
    lof = {r["id"]: r["lof"] for r in neighbours.local_outlier_factor(df, k, block_bytes=block_bytes).collect()}
    for i in range(90):
        assert lof[i] == pytest.approx(np.mean([lrd[j] for j in lists[i]]) / lrd[i], rel=1e-6)


@pytest.mark.parametrize("block_bytes", [10**7, 6000])
def test_classifiers_on_vectors(frame, block_bytes):
    points = make_points(80, 4, 5)
    rows = [(i, p.tolist(), int(p[0] > 0)) for i, p in enumerate(points)]
    train, test = frame(rows[:60], VEC), frame(rows[60:], VEC)
    knn = dict(neighbours.knn_classify(train, test, 5, block_bytes=block_bytes).collect())
    ball = dict(neighbours.radius_classify(train, test, 1.2, block_bytes=block_bytes).collect())
    for key, features, _ in rows[60:]:
        d = sorted((round(float(np.linalg.norm(np.array(f) - features)), 9), j, label) for j, f, label in rows[:60])
        votes = collections.Counter(label for _, _, label in d[:5])
        assert knn[key] == max(votes, key=lambda c: (votes[c], -c))
        inside = collections.Counter(label for x, _, label in d if x <= 1.2)
        assert ball[key] == (max(inside, key=lambda c: (inside[c], -c)) if inside else None)
    everyone = dict(neighbours.radius_classify(train, test, 500.0).collect())
    assert set(everyone.values()) == {collections.Counter(r[2] for r in rows[:60]).most_common(1)[0][0]}


def test_naive_bayes_matches_formula(frame):
    rows = make_commands(60, 11)
    train, test = rows[:45], rows[45:] + [(500, "unseen-term - ", 0)]
    model = bayes_fit(frame(train, CMD))
    got = {r["cmd_id"]: r for r in bayes_scores(frame(test, CMD), model).collect()}
    fitted = python_tfidf([r[1] for r in train], [r[1] for r in train])
    vocabulary = {t for v in fitted for t in v}
    mass = {c: collections.Counter() for c in (0, 1)}
    for (_, _, label), vector in zip(train, fitted, strict=True):
        for t, w in vector.items():
            mass[label][t] += w
    for (key, _, _), vector in zip(test, python_tfidf([r[1] for r in train], [r[1] for r in test]), strict=True):
        scores = {}
        for c in (0, 1):
            total = sum(mass[c].values()) + 0.001 * len(vocabulary)
            prior = sum(r[2] == c for r in train) / len(train)
            scores[c] = math.log(prior) + sum(w * math.log((mass[c][t] + 0.001) / total) for t, w in vector.items())
            assert got[key][f"log_p_{c}"] == pytest.approx(scores[c])
        assert got[key]["prediction"] == max(scores, key=lambda c: (scores[c], -c))


def test_centroid(frame):
    rows = make_commands(40, 13) + [(700, "- -", 1)]
    df = frame(rows, CMD)
    normal = [r for r in rows if r[2] == 0]
    got = {r["cmd_id"]: r["distance"] for r in centroid_distance(df, centroid_fit(df.where("label = 0"))).collect()}
    vectors = python_tfidf([r[1] for r in normal], [r[1] for r in normal] + [r[1] for r in rows])
    points = as_points(vectors)
    centre = points[: len(normal)].mean(axis=0)
    for (key, _, _), p in zip(rows, points[len(normal) :], strict=True):
        assert got[key] == pytest.approx(float(np.linalg.norm(p - centre)), abs=1e-9)
    report = centroid_detector(df).collect()
    assert all(0 <= r["accuracy"] <= 1 for r in report)


def test_exact_quantile_narrows_to_the_value(spark, monkeypatch):
    monkeypatch.setattr(quantile, "DRIVER_VALUES", 50)
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5).cache()
    for q in (0.0, 0.19, 0.3757, 0.5, 0.6, 0.999, 1.0):
        assert quantile.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)
    cut = quantile.contamination_cut(df.withColumnRenamed("v", "score"), 0.19)
    assert cut.where("prediction = -1").count() == int((values < np.quantile(values, 0.19)).sum())


def test_truncated_svd(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(200, 30)) * np.linspace(3, 0.1, 30) + 0.5
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, x array<double>").repartition(5)
    df = rows.select("id", array_to_vector("x").alias("features"))
    model = truncated_svd(df, 6, tolerance=1e-10)
    _, s, vt = np.linalg.svd(points, full_matrices=False)
    assert model.singular == pytest.approx(s[:6], rel=1e-6)
    got = np.array([r["reduced"] for r in svd_transform(df, model).orderBy("id").collect()])
    want = points @ vt[:6].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-4)
    ratio = want.var(axis=0) / points.var(axis=0).sum()
    assert model.ratio == pytest.approx(ratio, abs=1e-6)
    table = {r["k"]: r["explained"] for r in explained_variance(df, [2, 30]).collect()}
    assert table[2] == pytest.approx(ratio[:2].sum(), abs=1e-4) and table[30] == pytest.approx(1.0)


def test_weak_directions_settle_like_strong_ones(spark):
    """Defaults on 120 columns: every direction's residual is small beside its own energy, a wrong basis shows."""
    rng = np.random.default_rng(5)
    spread = 1.15 ** -np.arange(120.0)
    points = rng.normal(size=(300, 120)) * spread @ np.linalg.qr(rng.normal(size=(120, 120)))[0]
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "x array<double>").repartition(4)
    df = rows.select(array_to_vector("x").alias("features"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        model = truncated_svd(df, 20)
    _, s, vt = np.linalg.svd(points, full_matrices=False)
    assert model.singular == pytest.approx(s[:20], rel=1e-7)
    assert np.abs((vt[:20] @ model.components).diagonal()).min() > 0.99999
    found = sorted(direction_residuals(df, model).collect())
    assert [r["direction"] for r in found] == list(range(1, 21)) and max(r["residual"] for r in found) < 1.1e-4
    wrong = np.linalg.qr(rng.normal(size=(120, 20)))[0]
    energy = ((points @ wrong) ** 2).sum(axis=0)
    off = direction_residuals(df, SvdModel(wrong, np.sqrt(energy), energy, energy)).collect()
    assert min(r["residual"] for r in off) > 0.3


def test_svd_beyond_the_rank(spark):
    """More directions asked for than there are: the rest have no energy; an all-zero table has none at all."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 40))
    for rows, rank in ((points, 3), (np.zeros((5, 40)), 0)):
        frame = spark.createDataFrame([(p.tolist(),) for p in rows], "x array<double>")
        df = frame.select(array_to_vector("x").alias("features"))
        model = truncated_svd(df, 6)
        want = np.linalg.svd(rows, compute_uv=False)[:6]
        want = np.append(want, np.zeros(6 - len(want)))
        assert model.singular == pytest.approx(want, abs=1e-5)
        assert (model.singular > 1e-3).sum() == rank
        assert model.components.T @ model.components == pytest.approx(np.eye(6), abs=1e-9)


def test_svd_of_sparse_vectors_with_empty_rows(frame):
    rows = make_commands(40, 17) + [(800, "- x", 0)]
    df = frame(rows, CMD)
    featured = classifiers.hashed_tfidf(df, 64).transform(df).select("cmd_id", "features")
    dense = {r["cmd_id"]: r["features"].toArray() for r in featured.collect()}
    model = truncated_svd(featured, 5)
    for r in svd_transform(featured, model).collect():
        assert r["reduced"] == pytest.approx(list(dense[r["cmd_id"]] @ model.components), abs=1e-9)
    assert dense[800].sum() == 0
    norms = [np.linalg.norm(v) for k, v in dense.items() if k != 800 and v.any()]
    assert norms == pytest.approx([1.0] * len(norms))


def test_radius_of_signed_vectors(frame):
    """Opposite vectors are 2 apart: a radius of 1.5 does not take in every row."""
    train = frame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [-1.0, 0.0], 1)], VEC)
    test = frame([(9, [-1.0, 0.0], 0)], VEC)
    assert neighbours.radius_classify(train, test, 1.5).first()["prediction"] == 1
    assert neighbours.radius_classify(train, test, 2.1).first()["prediction"] == 0


@pytest.mark.parametrize("heavy", [0, 150_000, 290_000])
def test_quantiles_with_a_heavy_value(spark, heavy):
    """More copies of one value than the driver may hold, and the rank beside, on and past them."""
    rest = 300_000 - heavy
    df = spark.range(300_000).select(F.when(F.col("id") < heavy, F.lit(0.5)).otherwise((F.col("id") - heavy) / rest).alias("v"))
    values = np.concatenate([np.full(heavy, 0.5), np.arange(rest) / rest])
    for q in (0.0, 0.002, 0.49, 0.5, 0.51, 0.9, 1.0):
        assert quantile.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_linear_discriminant(frame):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(80, 4)), rng.normal(size=(40, 4)) + [2.5, 0, 1, 0]])
    rows = [(i, p.tolist(), int(i >= 80)) for i, p in enumerate(points)]
    df = frame(rows, VEC)
    model = discriminant_fit(df)
    labels = np.array([r[2] for r in rows])
    scatter = sum(np.cov(points[labels == c].T) * ((labels == c).sum() - 1) for c in (0, 1)) / (len(points) - 2)
    assert model.covariance == pytest.approx(scatter)
    assert model.means == pytest.approx(np.array([points[labels == c].mean(axis=0) for c in (0, 1)]))
    said = lda_classify(df, df).select("label", "prediction").collect()
    assert np.mean([r["label"] == r["prediction"] for r in said]) > 0.8
    inverse = np.linalg.inv(scatter)
    scores = np.array([points @ inverse @ m - 0.5 * m @ inverse @ m + math.log(np.mean(labels == c)) for c, m in enumerate(model.means)])
    got = {r["id"]: r["prediction"] for r in lda_classify(df, df).collect()}
    assert [got[i] for i in range(len(rows))] == scores.argmax(axis=0).tolist()


def planted(n=300, outliers=6, seed=4):
    rng = np.random.default_rng(seed)
    points = np.vstack([rng.normal(size=(n, 3)) * 0.3 + 5, rng.normal(size=(outliers, 3)) * 0.3 + [-6, 8, 0]])
    return [(i, p.tolist(), int(i >= n)) for i, p in enumerate(points)]


def test_one_class_svm(frame):
    rows = planted()
    df = frame(rows, VEC)
    model = one_class_fit(df.where("label = 0"), nu=0.05)
    scored = {r["id"]: (r["score"], r["prediction"]) for r in one_class_score(df, model).collect()}
    normal = [scored[i][1] for i, _, label in rows if not label]
    assert abs(normal.count(-1) / len(normal) - 0.05) < 0.02
    assert all(scored[i][1] == -1 for i, _, label in rows if label)
    points = np.array([p for _, p, label in rows if not label])
    # The dual bound: |w|^2 / 2 may not beat w . (mean of the nu-tail) - |w|^2 / 2 by much.
    margins = np.sort(points @ model.weights)[: int(0.05 * len(points))]
    assert model.weights @ model.weights == pytest.approx(margins.mean(), rel=0.05)


def test_one_class_svm_reaches_its_gap(frame):
    """Without a warning at the defaults, and no mixture of the nu-tails found by many plain steps is shorter."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(2000, 24)) + 0.3
    df = frame([(i, p.tolist(), 0) for i, p in enumerate(points)], VEC)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        model = one_class_fit(df, nu=0.1)
    weights = points.mean(axis=0)
    for _ in range(5000):
        tail = points[np.argsort(points @ weights)[:200]].mean(axis=0)
        away = weights - tail
        weights = weights - np.clip(weights @ away / (away @ away), 0, 1) * away
    assert model.weights @ model.weights == pytest.approx(weights @ weights, rel=2e-3)
    outside = [r["prediction"] for r in one_class_score(df, model).collect()].count(-1)
    assert outside <= 0.1 * 2000


def test_every_row_can_be_in_every_tree(frame):
    """Above the former pool of 20 samples: each tree gets its full sample, drawn from all rows."""
    rows = [(i, [float(i)], 0) for i in range(6000)]
    got = tree_samples(frame(rows, VEC), 50, 40, seed=1).toPandas()
    assert got.groupby("tree").size().tolist() == [40] * 50
    assert got.duplicated().sum() == 0 and got["id"].nunique() > 1500
    small = tree_samples(frame(rows[:30], VEC), 3, 40).toPandas()
    assert small.groupby("tree").size().tolist() == [30] * 3


def test_isolation_forest(frame):
    rows = planted()
    results = []
    for parts in (2, 7):
        scored = isolation_forest(frame(rows, VEC, parts), 40, 64, 0.02, seed=3)
        results.append({r["id"]: (r["score"], r["prediction"]) for r in scored.collect()})
    assert all(results[0][i][0] == pytest.approx(results[1][i][0]) for i in results[0])
    flagged = [i for i, (_, said) in results[0].items() if said == -1]
    assert 5 <= len(flagged) <= 8
    assert sum(rows[i][2] for i in flagged) >= 5
    assert all(-1 <= score < 0 for score, _ in results[0].values())


def test_fourier_features_approximate_the_kernel(frame):
    df = frame(make_commands(12, 23), CMD)
    vectors = tfidf.tfidf_vectors(df, tfidf.tfidf_fit(df))
    mapped = classifiers.fourier_features(vectors, 0.5, 4096, 0)
    rows = {r["cmd_id"]: {e["term"]: e["weight"] for e in r["vector"]} for r in vectors.collect()}
    terms = sorted({t for row in rows.values() for t in row})
    exact = {i: np.array([row.get(t, 0.0) for t in terms]) for i, row in rows.items()}
    approx = {r["cmd_id"]: r["fourier"].toArray() for r in mapped.collect()}
    for i in exact:
        for j in exact:
            kernel = math.exp(-0.5 * ((exact[i] - exact[j]) ** 2).sum())
            assert approx[i] @ approx[j] == pytest.approx(kernel, abs=0.08)


def separable(n, seed=0, start=0):
    rng = random.Random(seed)
    normal, bad = ["ls", "grep", "cat", "readlink", "tail"], ["wget", "chmod", "netcat", "passwd"]
    rows = []
    for i in range(n):
        label = int(i % 3 == 0)
        words = [rng.choice(bad if label and rng.random() < 0.8 else normal) for _ in range(6)]
        rows.append((start + i, " ".join(words + [f"arg{rng.randrange(20)}"]), label))
    return rows


def test_tree_and_svm_learn(frame):
    train, test = frame(separable(150), CMD), frame(separable(60, 5, 1000), CMD)
    tree = classifiers.predict(classifiers.decision_tree(train, num_features=256), test)
    svm = classifiers.rbf_svm_predict(classifiers.rbf_svm(train, dimensions=256), test)
    for answers in (tree, svm):
        rows = answers.collect()
        assert len(rows) == 60
        assert np.mean([r["label"] == r["prediction"] for r in rows]) > 0.9


def test_bagged_trees_roundtrip(spark, frame, tmp_path):
    df = frame(separable(120), CMD)
    models = classifiers.bagged_trees(df.where("label = 0"), df.where("label = 1"), chunk=20, step=25, num_features=128)
    assert len(models) == 3
    classifiers.save_models(models, str(tmp_path / "m"))
    loaded = classifiers.load_models(spark, str(tmp_path / "m"))
    answers = [sorted(map(tuple, classifiers.ensemble_predict(m, df).collect())) for m in (models, loaded)]
    assert answers[0] == answers[1]
    assert np.mean([label == said for _, label, said in answers[0]]) > 0.9


def test_first_majority(frame):
    df = frame([(0, [1, 0]), (1, [0, 1, 1]), (2, [0, 1]), (3, [2])], "i int, a array<int>")
    got = dict(df.select("i", classifiers.first_majority(F.col("a")).alias("v")).collect())
    assert got == {0: 1, 1: 1, 2: 0, 3: 2}


def test_pruning_skips_far_cells(frame):
    """Clusters far apart: a query meets the rows of its own surroundings, not all rows."""
    import pyarrow as pa

    from auditlens.operators.cells import pivot_join

    class CountRows:
        """(id, label, n): how many reference rows each query was compared with."""

        def __init__(self, queries):
            self.ids, self.seen = queries["id"], 0

        def feed(self, batch):
            self.seen += batch.num_rows

        def finish(self):
            n = len(self.ids)
            return pa.table({"id": self.ids, "label": pa.array([0] * n, pa.int32()), "n": pa.array([self.seen] * n, pa.int64())})

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 4)) * 100
    points = centres[np.arange(600) % 20] + rng.normal(size=(600, 4))
    df = frame([(i, p.tolist(), 0) for i, p in enumerate(points)], VEC).select("id", "features", F.lit(0).alias("label"))
    met = pivot_join(df.drop("label"), df, CountRows, "id long, label int, n long", False, 8 * F.size("features"), 8000, radius=3.0)
    seen = {r["id"]: r["s"] for r in met.groupBy("id").agg(F.sum("n").alias("s")).collect()}
    inside = (np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= 3.0).sum(axis=1)
    assert all(seen[i] >= inside[i] for i in range(600))
    assert sum(seen.values()) < 0.2 * 600 * 600


def test_nearest_distance_over_many_sizes(frame):
    """Lists of 1 to 150 tokens: the search by size skips far sizes and stays exact."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(60)]

    def texts(n, start):
        return [(start + i, " ".join(rng.choice(words) for _ in range(int(150 ** rng.random()))), 0) for i in range(n)]

    query, reference = texts(60, 0) + [(99, " ".join(words * 9), 0)], texts(150, 1000)
    for normalised in (True, False):
        got = nearest_distance(frame(query, CMD), frame(reference, CMD), normalised=normalised, block_bytes=9000)
        found = {r["cmd_id"]: r["distance"] for r in got.collect()}
        for key, text, _ in query:
            a = text.split(" ")
            lists = [t.split(" ") for _, t, _ in reference]
            best = min(gap(a, b) / (len(a) + len(b) if normalised else 1) for b in lists)
            assert found[key] == pytest.approx(best, abs=1e-12)


def test_search_by_size_skips_far_sizes(frame):
    import pyarrow as pa

    from auditlens.operators import cells, scanners
    from auditlens.operators.nearest import _sides

    class Counting(scanners.NearestOverlap):
        """Counts the compared rows in the numerator of an extra row per query."""

        def __init__(self, queries):
            super().__init__(queries)
            self.seen = 0

        def feed(self, batch):
            super().feed(batch)
            self.seen += batch.num_rows

        def finish(self):
            extra = pa.table(
                {
                    "id": self.ids.cast(pa.int64()),
                    "numerator": pa.array([10**9 + self.seen] * len(self.ids), pa.int64()),
                    "denominator": pa.array([1] * len(self.ids), pa.int64()),
                }
            )
            return pa.concat_tables([super().finish(), extra])

    lists = [(i, " ".join(f"t{i % 3}x{j}" for j in range(3 ** (i % 6))), 0) for i in range(300)]
    sides = _sides(frame(lists, CMD), "cmd_id", tfidf.tokens_word(F.col("command")))
    met = cells.size_join(sides, sides, Counting, scanners.NearestOverlap.SCHEMA, 8 * F.size("tokens"), 20_000, True)
    seen = met.where("numerator >= 1000000000").agg(F.sum(F.col("numerator") - 10**9)).first()[0]
    assert 300 * 50 <= seen < 0.4 * 300 * 300
    best = met.where("numerator < 1000000000").groupBy("id").agg(F.min(F.col("numerator") / F.col("denominator")))
    assert all(r[1] == 0.0 for r in best.collect()) and best.count() == 300
