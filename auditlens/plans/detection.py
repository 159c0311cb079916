"""Detectors behind one interface, and their evaluation.

A detector is a function that fits on a labelled frame (cmd_id, command, label) and returns a
predictor, a function from such a frame to (cmd_id, label, prediction).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import HASH_RANGE, hash_uint32
from ..functions.text import signed_label
from ..operators import classifiers
from ..operators.aggregates import curve_summary
from ..operators.bayes import bayes_fit, bayes_scores
from ..operators.evaluation import accuracy, classification_report
from ..operators.injection import inject
from ..operators.isolation import isolation_forest
from ..operators.neighbours import knn_classify, local_outlier_factor
from ..operators.oneclass import one_class_fit, one_class_score
from ..operators.projection import project_terms
from ..operators.quantile import contamination_cut
from ..operators.reduction import svd_transform, truncated_svd
from ..operators.sampling import below_fraction, hash_position, k_fold, train_test_split
from ..operators.tfidf import tfidf_fit, tfidf_vectors
from ..session import cut_lineage

Predictor = Callable[[DataFrame], DataFrame]
Detector = Callable[[DataFrame], Predictor]

KEPT = ("cmd_id", "label")


def bayes(train: DataFrame, alpha: float = 0.001) -> Predictor:
    model = bayes_fit(train, alpha)
    return lambda df: bayes_scores(df, model, keep=("label",)).select(*KEPT, "prediction")


def knn(train: DataFrame, k: int = 3) -> Predictor:
    model = tfidf_fit(train)
    vectors = tfidf_vectors(train, model, keep=("label",))

    def predict(df: DataFrame) -> DataFrame:
        answers = knn_classify(vectors, tfidf_vectors(df, model), k, id="cmd_id")
        return df.select(*KEPT).join(answers, "cmd_id")

    return predict


def decision_tree(train: DataFrame, max_depth: int = 9, min_leaf: int = 1) -> Predictor:
    return partial(classifiers.predict, classifiers.decision_tree(train, max_depth, min_leaf))


def rbf_svm(train: DataFrame, c: float = 1.0, gamma: float = 0.5) -> Predictor:
    return partial(classifiers.rbf_svm_predict, classifiers.rbf_svm(train, c, gamma))


DETECTORS: Mapping[str, Detector] = {"svm": rbf_svm, "tree": decision_tree, "bayes": bayes}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def compare_detectors(
    df: DataFrame, detectors: Mapping[str, Detector] = DETECTORS, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """``(detector, class, precision, recall, f1, support)`` on one common split; models see the
    train side only."""
    train, test = train_test_split(df, fraction, "cmd_id", seed)
    answers = [fit(train)(test).withColumn("detector", F.lit(name)) for name, fit in detectors.items()]
    return classification_report(_union(answers), by=("detector",))


def injection_report(
    df: DataFrame,
    detectors: Mapping[str, Detector] = DETECTORS,
    n: int = 100,
    seed: int = 0,
    fraction: float = 0.2,
) -> DataFrame:
    """Report per detector on injected commands after training on the train split."""
    train, _ = train_test_split(df, fraction, "cmd_id", 42)
    attacks = inject(df.where("label = 0"), df.where("label = 1"), n=n, seed=seed, key="cmd_id").select(
        ((F.col("normal_no") - 1) * n + F.col("abnormal_no")).alias("cmd_id"), "command", "label"
    )
    answers = [fit(train)(attacks).withColumn("detector", F.lit(name)) for name, fit in detectors.items()]
    return classification_report(_union(answers), by=("detector",))


def cross_val_score(detector: Detector, df: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``(fold, score)``: accuracy on each fold after fitting on the others."""
    folds = cut_lineage(k_fold(df, k, "cmd_id", seed))
    scores = [
        accuracy(detector(folds.where(F.col("fold") != i).drop("fold"))(folds.where(F.col("fold") == i).drop("fold")))
        .select(F.lit(i).cast("bigint").alias("fold"), F.col("accuracy").alias("score"))
        for i in range(k)
    ]
    return _union(scores)


def learning_curve(
    detector: Detector,
    df: DataFrame,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    splits: int = 10,
    fraction: float = 0.2,
    seed: int = 0,
) -> DataFrame:
    """``(train_size, side, mean_score, std_score)`` over random splits and nested train subsets.

    A smaller train set is a hash prefix of a larger one, so subsets nest without another sample.
    """
    scores = []
    for split in range(splits):
        test_row = below_fraction(F.concat_ws("|", F.lit(split), "cmd_id"), fraction, seed)
        train, test = df.where(~test_row), df.where(test_row)
        for size in sizes:
            inside = hash_uint32(F.concat_ws("|", F.lit(split), "cmd_id"), f"{seed}-size") < int(size * HASH_RANGE)
            subset = train.where(inside)
            predict = detector(subset)
            for side, rows in (("train", subset), ("test", test)):
                scored = accuracy(predict(rows)).select(
                    F.lit(float(size)).alias("train_size"), F.lit(side).alias("side"), F.col("accuracy").alias("score")
                )
                scores.append(scored)
    return curve_summary(_union(scores), ("train_size", "side"))


def grid_folds(df: DataFrame, folds: int) -> DataFrame:
    """``df`` with the ``fold`` of each row: hash positions dealt in turn."""
    fold = ((F.col("position") - 1) % folds).cast("int")
    return hash_position(df, "cmd_id").withColumn("fold", fold).drop("position")


def grid_search(
    df: DataFrame,
    depths: Sequence[int] = (3, 6, 9),
    leaves: Sequence[int] = (1, 5),
    folds: int = 3,
    num_features: int | None = classifiers.FEATURES,
) -> DataFrame:
    """``(max_depth, min_leaf, score)``: mean accuracy of a decision tree over hash-ordered folds.

    TF-IDF is fitted inside each fold, on its train rows; its vectors are stored once for all settings.
    """
    dealt = cut_lineage(grid_folds(df.select("cmd_id", "command", "label"), folds))
    scores = []
    for fold in range(folds):
        train = dealt.where(F.col("fold") != fold)
        model = classifiers.hashed_tfidf(train, num_features)
        featured = cut_lineage(model.transform(dealt).select("features", "label", "fold"))
        seen, unseen = featured.where(F.col("fold") != fold), featured.where(F.col("fold") == fold)
        for depth in depths:
            for leaf in leaves:
                tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, seed=0).fit(seen)
                said = tree.transform(unseen).select("label", F.col("prediction").cast("int").alias("prediction"))
                scores.append(
                    accuracy(said).select(
                        F.lit(depth).alias("max_depth"), F.lit(leaf).alias("min_leaf"), F.col("accuracy").alias("score")
                    )
                )
    return _union(scores).groupBy("max_depth", "min_leaf").agg(F.avg("score").alias("score"))


def text_vectors(df: DataFrame, dimensions: int = 1024, seed: int = 0, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """``(cmd_id, *keep, features)``: TF-IDF of exact terms projected to a fixed number of dimensions."""
    vectors = tfidf_vectors(df, tfidf_fit(df), keep=keep)
    return project_terms(vectors, dimensions, seed)


def text_outliers(
    df: DataFrame,
    k: int = 100,
    dimensions: int = 1024,
    nu: float = 0.002,
    contamination: float = 0.19,
    neighbours: int = 20,
    n_trees: int = 100,
    max_samples: int = 5000,
    seed: int = 0,
) -> DataFrame:
    """``(detector, cmd_id, label, prediction)`` on +1 (normal) and -1 for three outlier detectors on texts.

    TF-IDF, projected and reduced to ``k`` singular directions; a one-class SVM fitted on the normals, an
    isolation forest and the local outlier factor see the same vectors.
    """
    featured = cut_lineage(text_vectors(df, dimensions, seed)).withColumn("vector", array_to_vector("features"))
    model = truncated_svd(featured.select("vector"), k, "vector")
    reduced = cut_lineage(
        svd_transform(featured.select("cmd_id", "label", "vector"), model, "vector", "features")
    )
    signed = signed_label(F.col("label")).alias("label")
    one_class = one_class_score(reduced, one_class_fit(reduced.where("label = 0"), nu))
    forest = isolation_forest(reduced, n_trees, max_samples, contamination, seed, "cmd_id")
    factor = contamination_cut(
        local_outlier_factor(reduced, neighbours, "cmd_id").select("cmd_id", "score"), contamination
    ).join(reduced.select("cmd_id", "label"), "cmd_id")
    found = {"one_class_svm": one_class, "isolation_forest": forest, "local_outlier_factor": factor}
    return _union(
        [rows.select(F.lit(name).alias("detector"), "cmd_id", signed, "prediction") for name, rows in found.items()]
    )


def text_outlier_report(df: DataFrame, **parameters) -> DataFrame:
    """Report of :func:`text_outliers` per detector."""
    return classification_report(text_outliers(df, **parameters), by=("detector",))
