"""Centroid detector: distance to the mean TF-IDF vector of the normal commands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NORMAL
from ..session import cut_lineage
from .evaluation import sweep_score
from .tfidf import summed_terms, tfidf_fit, tfidf_transform, weighted_terms


@dataclass(frozen=True)
class CentroidModel:
    """``terms``: (term, idf, centre); ``squared``: squared length of the centre."""

    terms: DataFrame
    squared: float


def centroid_fit(normals: DataFrame, id: str = "cmd_id", text: str = "command") -> CentroidModel:
    """Fit terms and centre on the normals; the term table is stored once."""
    model = tfidf_fit(normals, text)
    weights = tfidf_transform(normals, model, id, text)
    centre = weights.groupBy("term").agg((F.sum("weight") / model.documents).alias("centre"))
    terms = cut_lineage(model.terms.join(centre, "term").select("term", "idf", "centre"))
    return CentroidModel(terms, _squared(terms))


def _squared(terms: DataFrame) -> float:
    return terms.agg(F.coalesce(F.sum(F.col("centre") * F.col("centre")), F.lit(0.0))).first()[0]


def save_centroid(model: CentroidModel, path: str) -> None:
    """Write the term table, which is the whole model."""
    model.terms.write.parquet(path)


def load_centroid(spark: SparkSession, path: str) -> CentroidModel:
    """A model written by :func:`save_centroid`."""
    terms = spark.read.parquet(path)
    return CentroidModel(terms, _squared(terms))


def centroid_terms(
    df: DataFrame, model: CentroidModel, id: str = "cmd_id", text: str = "command", keep: tuple[str, ...] = ()
) -> DataFrame:
    """What :func:`distance_of_terms` sums up: the terms of each row with the model's weights. ``df`` may be a stream."""
    return weighted_terms(df, model.terms, ("centre",), id, text, keep)


def distance_of_terms(
    terms: DataFrame, model: CentroidModel, id: str = "cmd_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, distance)`` of rows of :func:`centroid_terms`, Euclidean: sqrt(x.x - 2 x.c + c.c)."""
    scored = summed_terms(terms, ("centre",), id, keep)
    own = F.when(F.col("norm") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    squared = own - 2 * F.col("centre") + F.lit(model.squared)
    return scored.select(id, *keep, F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))


def centroid_distance(
    df: DataFrame, model: CentroidModel, id: str = "cmd_id", text: str = "command", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, distance)`` to the centre."""
    return distance_of_terms(centroid_terms(df, model, id, text, keep), model, id, keep)


def centroid_detector(
    df: DataFrame, id: str = "cmd_id", text: str = "command", label: str = "label"
) -> DataFrame:
    """Fit on the normals, score every row, report for 300 bounds."""
    model = centroid_fit(df.where(F.col(label) == NORMAL), id, text)
    return sweep_score(centroid_distance(df, model, id, text, (label,)), "distance", label)
