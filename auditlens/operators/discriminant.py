"""Linear discriminant analysis from distributed class moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import affine, class_moments


@dataclass(frozen=True)
class DiscriminantModel:
    classes: list[int]
    means: np.ndarray
    covariance: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def discriminant_fit(df: DataFrame, features: str = "features", label: str = "label") -> DiscriminantModel:
    """Class means, pooled within-class covariance (n - classes) and the linear score of each class.

    Only one d x d matrix per class reaches the driver; directions without variance are ignored.
    """
    rows = sorted(class_moments(df, features, label).collect(), key=lambda r: r["label"])
    n = np.array([r["n"] for r in rows], dtype=float)
    means = np.array([r["total"].toArray() for r in rows]) / n[:, None]
    d = means.shape[1]
    scatter = sum(
        r["gram"].toArray().reshape(d, d) - c * np.outer(m, m) for r, c, m in zip(rows, n, means, strict=True)
    )
    covariance = scatter / max(n.sum() - len(rows), 1.0)
    weights = np.linalg.pinv(covariance, rcond=1e-10, hermitian=True) @ means.T
    offset = np.log(n / n.sum()) - 0.5 * np.einsum("cd,dc->c", means, weights)
    return DiscriminantModel([int(r["label"]) for r in rows], means, covariance, weights, offset)


def discriminant_predict(df: DataFrame, model: DiscriminantModel, features: str = "features") -> DataFrame:
    """Add ``scores`` (one per class, in class order) and ``prediction``."""
    scored = df.withColumn("scores", affine(F.col(features), model.weights, model.offset))
    classes = F.array(*[F.lit(c) for c in model.classes])
    place = F.array_position("scores", F.array_max("scores")).cast("int")
    return scored.withColumn("prediction", F.get(classes, place - 1))


def lda_classify(
    train: DataFrame, test: DataFrame, features: str = "features", label: str = "label"
) -> DataFrame:
    """Fit on ``train``, predict ``test``."""
    return discriminant_predict(test, discriminant_fit(train, features, label), features)
