"""Arrow helpers for feature arrays: affine maps and class moments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Numbers of one (entries x columns) block held while multiplying.
BLOCK = 4_000_000


def unwrap(df: DataFrame, features: str, kept: list[str]) -> DataFrame:
    """``kept`` columns and the parts of a vector column: ``_at`` (null for a dense vector) and
    ``_values``."""
    rows = df.withColumn("_v", F.unwrap_udt(features))
    return rows.select(*kept, F.col("_v.indices").alias("_at"), F.col("_v.values").alias("_values"))


class Rows:
    """Vectors of one Arrow batch in compressed row form."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        values, at = batch.column("_values"), batch.column("_at")
        self.n = batch.num_rows
        self.length = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        self.edge = np.concatenate(([0], np.cumsum(self.length)))
        self.values = values.flatten().to_numpy(zero_copy_only=False)
        # Dense rows only: one matrix, multiplied as such.
        self.whole = self.n > 0 and at.null_count == self.n and bool((self.length == width).all())
        if self.whole:
            self.at = np.zeros(0, dtype=np.int64)
        elif at.null_count == 0:
            self.at = at.flatten().to_numpy(zero_copy_only=False)
        else:
            self.at = np.concatenate(
                [np.arange(width) if one is None else np.asarray(one, dtype=np.int64) for one in at.to_pylist()]
                or [np.zeros(0, dtype=np.int64)]
            )

    def _blocks(self, columns: int) -> Iterator[tuple[int, int]]:
        first = 0
        while first < self.n:
            last = int(np.searchsorted(self.edge, self.edge[first] + BLOCK // max(1, columns), "right")) - 1
            last = min(self.n, max(first + 1, last))
            yield first, last
            first = last

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows @ matrix."""
        if self.whole:
            return self.values.reshape(self.n, -1) @ matrix
        out = np.zeros((self.n, matrix.shape[1]))
        for first, last in self._blocks(matrix.shape[1]):
            part = slice(self.edge[first], self.edge[last])
            filled = np.flatnonzero(self.length[first:last])
            if len(filled):
                products = self.values[part, None] * matrix[self.at[part]]
                starts = self.edge[first:last][filled] - self.edge[first]
                out[first + filled] = np.add.reduceat(products, starts, axis=0)
        return out

    def dense(self, width: int) -> np.ndarray:
        """The rows as a matrix."""
        if self.whole:
            return self.values.reshape(self.n, width)
        out = np.zeros((self.n, width))
        out[np.repeat(np.arange(self.n), self.length), self.at] = self.values
        return out

    def transposed_times(self, matrix: np.ndarray, out: np.ndarray) -> None:
        """Add rows.T @ matrix to ``out``."""
        if self.whole:
            out += self.values.reshape(self.n, -1).T @ matrix
            return
        row = np.repeat(np.arange(self.n), self.length)
        for first, last in self._blocks(matrix.shape[1]):
            part = slice(self.edge[first], self.edge[last])
            order = np.argsort(self.at[part], kind="stable")
            columns = self.at[part][order]
            if len(columns):
                starts = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1])))
                products = self.values[part][order, None] * matrix[row[part][order]]
                out[columns[starts]] += np.add.reduceat(products, starts, axis=0)


def list_column(matrix: np.ndarray) -> pa.Array:
    """Matrix rows as a list column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def map_vectors(df: DataFrame, features: str, output: str, apply, width: int) -> DataFrame:
    """Replace a vector column by ``output``, the array ``apply(Rows)`` gives per row."""
    kept = [c for c in df.columns if c != features]
    rows = unwrap(df, features, kept)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = list_column(apply(Rows(batch, width)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], names=[*kept, output])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]
    return rows.mapInArrow(project, ", ".join([*fields, f"`{output}` array<double>"]))


def dense(features: pd.Series) -> np.ndarray:
    """Rows of equally long arrays as a matrix."""
    return np.stack(features.to_numpy()).astype(np.float64) if len(features) else np.zeros((0, 0))


def affine(features: Column, weights: np.ndarray, offset: np.ndarray) -> Column:
    """``features @ weights + offset`` as an array column; both operands have a fixed size."""

    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        return pd.Series(list(dense(batch) @ weights + offset))

    return apply(features.cast("array<double>"))


def class_moments(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """``(label, n, total, gram)``: count, sum vector and flattened sum of x xT per class.

    Every task reduces its rows to one d x d matrix per class; these are added up in the JVM, first
    in groups of about the square root of the number of tasks, so that no reducer gets one per task.
    """
    rows = df.select(F.col(label).cast("int").alias("label"), F.col(features).cast("array<double>").alias("x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            points = flat.reshape(batch.num_rows, -1)
            for c in np.unique(labels):
                own = points[labels == c]
                n, total, gram = sums.get(int(c), (0, 0.0, 0.0))
                sums[int(c)] = (n + len(own), total + own.sum(axis=0), gram + own.T @ own)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array(list(sums), pa.int32()),
                    "n": pa.array([s[0] for s in sums.values()], pa.int64()),
                    "total": pa.array([s[1] for s in sums.values()], pa.list_(pa.float64())),
                    "gram": pa.array([s[2].ravel() for s in sums.values()], pa.list_(pa.float64())),
                }
            )

    parts = rows.mapInArrow(partial, "label int, n long, total array<double>, gram array<double>").select(
        "label", "n", array_to_vector("total").alias("total"), array_to_vector("gram").alias("gram"),
        task_group(df).alias("part"),
    )
    sums = (F.sum("n").alias("n"), *[Summarizer.sum(F.col(c)).alias(c) for c in ("total", "gram")])
    return parts.groupBy("label", "part").agg(*sums).groupBy("label").agg(*sums)


def task_group(df: DataFrame) -> Column:
    """A task's group in a two-level sum over the tasks that read ``df``: as many groups as members."""
    files = max(1, len(df.inputFiles()))
    return F.spark_partition_id() % max(2, math.isqrt(files) + 1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
