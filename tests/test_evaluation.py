from __future__ import annotations

import random

import pytest

from auditlens.operators import evaluation
from auditlens.plans import curves, detection
from auditlens.plans.curves import bayes_learning_curve
from tests.test_detectors import CMD, separable

PRED = "id long, label int, prediction int"


def test_report(frame):
    df = frame([(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 1), (4, 0, 0)], PRED)
    got = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert (got["0"]["precision"], got["0"]["recall"], got["0"]["support"]) == (1.0, pytest.approx(2 / 3), 3)
    assert (got["1"]["precision"], got["1"]["recall"]) == (pytest.approx(2 / 3), 1.0)
    assert got["accuracy"]["f1"] == pytest.approx(0.8) and got["accuracy"]["support"] == 5
    assert got["macro avg"]["precision"] == pytest.approx(5 / 6)
    assert got["weighted avg"]["recall"] == pytest.approx(0.8)


def test_report_zero_denominators(frame):
    df = frame([(0, 0, 0), (1, 1, 0)], PRED)
    got = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["f1"]) == (0.0, 0.0, 0.0)
    only = {r["class"]: r for r in evaluation.classification_report(frame([(0, 1, -1)], PRED)).collect()}
    assert only["-1"]["support"] == 0 and only["1"]["recall"] == 0.0


def test_confusion_and_accuracy(frame):
    df = frame([(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, 0)], PRED)
    assert tuple(evaluation.confusion(df).first()) == (1, 1, 2, 1)
    assert evaluation.accuracy(df).first()[0] == pytest.approx(0.4)


def test_fraction_sweep_is_exact_at_the_bounds(frame):
    cases = [(n, d) for d in (1, 3, 7, 20, 40) for n in range(0, d + 1)]
    df = frame([(n, d, i % 2) for i, (n, d) in enumerate(cases)], "numerator long, denominator long, label int")
    rows = {r["bound_index"]: r for r in evaluation.sweep_fraction(df).collect()}
    assert len(rows) == 21 and rows[10]["bound"] == 0.45
    for i in range(21):
        above = [n * 40 > (8 + i) * d for n, d in cases]
        counts = [sum(a == bool(said) and k % 2 == c for k, a in enumerate(above)) for c, said in ((0, 0), (0, 1), (1, 0), (1, 1))]
        assert [rows[i][c] for c in ("tp", "fn", "fp", "tn")] == counts


def test_score_sweep(frame):
    grid = evaluation.linspace(0.8, 1.2, 300)
    rng = random.Random(1)
    scores = [rng.uniform(0.7, 1.3) for _ in range(200)] + [grid[0], grid[7], grid[150], grid[299], -1e300, 1e300]
    df = frame([(s, i % 2) for i, s in enumerate(scores)], "distance double, label int")
    rows = {r["bound_index"]: r for r in evaluation.sweep_score(df).collect()}
    for i, bound in enumerate(grid):
        tp = sum(s < bound for s in scores[::2])
        fp = sum(s < bound for s in scores[1::2])
        assert (rows[i]["tp"], rows[i]["fp"], rows[i]["bound"]) == (tp, fp, bound)


def test_score_sweep_leaves_out_zero_denominators(frame):
    df = frame([(0.9, 0), (1.0, 1)], "distance double, label int")
    bounds = [r["bound"] for r in evaluation.sweep_score(df).collect()]
    assert min(bounds) > 0.9 and max(bounds) <= 1.0


def test_model_evaluation(frame):
    df = frame(separable(90), CMD).cache()
    folds = detection.cross_val_score(detection.bayes, df, 3).collect()
    assert [r["fold"] for r in folds] == [0, 1, 2] and all(r["score"] > 0.8 for r in folds)
    curve = detection.learning_curve(detection.bayes, df, sizes=(0.4, 1.0), splits=2).collect()
    assert {(r["train_size"], r["side"]) for r in curve} == {(s, x) for s in (0.4, 1.0) for x in ("train", "test")}
    assert all(0.5 < r["mean_score"] <= 1.0 and r["std_score"] >= 0 for r in curve)


def test_one_pass_learning_curve_equals_the_runs_one_by_one(frame):
    df = frame(separable(80), CMD)
    one_by_one = detection.learning_curve(detection.bayes, df, sizes=(0.4, 1.0), splits=2)
    at_once = bayes_learning_curve(df, sizes=(0.4, 1.0), splits=2)
    keys = ("train_size", "side")
    first, second = ({tuple(r[k] for k in keys): r for r in x.collect()} for x in (one_by_one, at_once))
    assert set(first) == set(second) and len(first) == 4
    for key, row in first.items():
        assert second[key]["mean_score"] == pytest.approx(row["mean_score"])
        assert second[key]["std_score"] == pytest.approx(row["std_score"], abs=1e-9)


def test_learning_curve_in_one_block_and_in_many(frame, monkeypatch):
    rows = separable(80) + [(3, "ls twice", 1), (5, None, 0), (None, "wget passwd", 1)]
    df = frame(rows, CMD)

    def curve(chars):
        monkeypatch.setattr(curves, "BLOCK_CHARS", chars)
        found = bayes_learning_curve(df, sizes=(0.4, 1.0), splits=2).collect()
        return {(r["train_size"], r["side"]): (r["mean_score"], r["std_score"]) for r in found}

    whole, cut = curve(1 << 20), curve(100)
    assert set(whole) == set(cut) and len(cut) == 4
    for key, values in whole.items():
        assert cut[key] == pytest.approx(values)


def test_text_outliers(frame):
    rows = [(i, f"ls grep cat tail{i % 4} file{i % 9}", 0) for i in range(90)]
    rows += [(100 + i, f"wget passwd{i} netcat{i} chmod{i}", 1) for i in range(10)]
    got = detection.text_outliers(frame(rows, CMD), k=5, dimensions=128, nu=0.05, contamination=0.1, neighbours=12).collect()
    assert {r["detector"] for r in got} == {"one_class_svm", "isolation_forest", "local_outlier_factor"}
    assert len(got) == 300 and {r["prediction"] for r in got} == {-1, 1}
    alarms = [r["label"] for r in got if r["detector"] == "one_class_svm" and r["prediction"] == -1]
    assert alarms.count(-1) == 10


def test_comparison_and_injection(frame):
    df = frame(separable(120), CMD).cache()
    detectors = {"bayes": detection.bayes, "knn": detection.knn, "tree": detection.decision_tree}
    report = detection.compare_detectors(df, detectors).collect()
    accuracy = {r["detector"]: r["f1"] for r in report if r["class"] == "accuracy"}
    assert set(accuracy) == set(detectors) and min(accuracy.values()) > 0.8
    attack = {r["detector"]: r for r in detection.injection_report(df, {"bayes": detection.bayes}, n=10).collect() if r["class"] == "1"}
    assert attack["bayes"]["support"] == 100


def test_grid_search(frame):
    got = detection.grid_search(frame(separable(60), CMD), depths=(1, 3), leaves=(1,), folds=2, num_features=64).collect()
    assert sorted((r["max_depth"], r["min_leaf"]) for r in got) == [(1, 1), (3, 1)]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_learning_curve_sends_a_matrix_per_bucket_of_terms(spark, monkeypatch):
    """What blocks send grows with buckets, not a row of numbers per block and term."""
    from auditlens.plans import curves

    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 40)), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "cmd_id long, command string, label int")
    sent, plain = {}, curves.stored
    monkeypatch.setattr(curves, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(curves, "stored", lambda df, name: sent.setdefault(name, plain(df, name)))
    curve = curves.bayes_learning_curve(df, splits=2)
    blocks = 1 + sum(len(r[1]) for r in rows) // 2000
    counts = {name: kept.count() for name, kept in sent.items() if name != "curve-rows"}
    assert counts and all(n <= (blocks + 1) ** 2 for n in counts.values())
    assert curve.count() == 10
