"""Document quality by Bradley-Terry ranking.

A document's worth is a weighted sum of features of its whole text. The weights make good documents
win against bad ones: logistic loss on the feature differences of (good, bad) pairs, by Newton's
method. The cut is a quantile of the training scores, at the share of bad documents; the reported
score is the logistic function of the distance to the cut.

The weights are fitted on at most ``TRAIN_ROWS`` labelled rows, picked by a hash of their id, and
``PARTNERS`` opponents per row. Only their features reach the driver; no label, language, source or
id does. All documents are scored in one pass that shuffles nothing.

* null and empty texts have features (of no words) and so a score
* rows without a label, or with a label for an unknown document, train nothing
* with labels of one class only every score is 0.5 (predicted 1); an empty table gives an empty result
* other columns are never read
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordIds, word_ids

TRAIN_ROWS = 20_000
PARTNERS = 10
WINDOW = 64
RIDGE = 1e-3
STEPS = 50

FEATURES = (
    "symbol_share",
    "symbol_runs",
    "capital_share",
    "digit_share",
    "wide_share",
    "repeated_neighbours",
    "repeated_in_window",
    "repeated_lines",
    "word_length",
    "odd_word_length",
    "words",
)

# Byte classes: 0 other, 1 lower case, 2 capital, 3 digit, 4 symbol, 5 beyond ASCII, 6 white space.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "!#$%&*+/<=>?@\\^_`{|}~"]] = 4
_CLASS[128:] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def features(text: bytes | None, ids: WordIds) -> np.ndarray:
    """The values of ``FEATURES`` for one text, all of it."""
    text = text or b""
    kinds = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    counts = np.bincount(kinds, minlength=7).astype(float)
    solid = max(1.0, counts.sum() - counts[6])
    words = word_ids(text, ids)
    n = len(words)
    symbols = kinds == 4
    runs = float((symbols[1:] & symbols[:-1]).sum()) if len(kinds) > 1 else 0.0
    neighbours = float((words[1:] == words[:-1]).sum()) if n > 1 else 0.0
    whole = n // WINDOW * WINDOW
    repeats = 0
    if whole:
        blocks = np.sort(words[:whole].reshape(-1, WINDOW), axis=1)
        repeats = int((blocks[:, 1:] == blocks[:, :-1]).sum())
    rest = words[whole:]
    if n:
        repeats += len(rest) - len(np.unique(rest))
    lines = [line for line in text.split(b"\n") if line.strip()]
    length = (solid - counts[5] / 2) / max(1, n)
    return np.array(
        [
            np.sqrt(counts[4] / solid),
            np.sqrt(min(1.0, runs / max(1, n))),
            counts[2] / max(1.0, counts[1] + counts[2]),
            np.sqrt(counts[3] / solid),
            counts[5] / solid,
            neighbours / max(1, n - 1),
            repeats / max(1, n),
            1.0 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
            min(length, 40.0),
            min(abs(length - 5.3), 20.0),
            np.log1p(min(n, 50)),
        ]
    )


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: standardised features times weights, the cut, and the unit of the score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    unit: float

    def worth(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -20, 20) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip((self.worth(rows) - self.cut) / self.unit, -500, 500)))


def fit_ranking(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> Ranking:
    """Weights from pairs of a good (1) and a bad (0) row; ``rows`` are feature rows in any fixed order."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    centre = rows.mean(axis=0)
    scale = np.maximum(rows.std(axis=0), 1e-6)
    x = np.clip((rows - centre) / scale, -20, 20)
    random = np.random.default_rng(seed)
    winners = np.concatenate([np.repeat(good, PARTNERS), random.choice(good, len(bad) * PARTNERS)])
    losers = np.concatenate([random.choice(bad, len(good) * PARTNERS), np.repeat(bad, PARTNERS)])
    gaps = x[winners] - x[losers]
    weights = np.zeros(d)
    for _ in range(STEPS):
        lose = 1.0 / (1.0 + np.exp(np.clip(gaps @ weights, -500, 500)))
        gradient = gaps.T @ lose / len(gaps) - RIDGE * weights
        hessian = (gaps * (lose * (1 - lose))[:, None]).T @ gaps / len(gaps) + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    worth = x @ weights
    # Between the two training scores that enclose the share of bad rows.
    cut = float(np.quantile(worth, len(bad) / len(rows), method="midpoint"))
    unit = max(1e-6, float(np.median(worth[good]) - np.median(worth[bad])) / 10)
    return Ranking(centre, scale, weights, cut, unit)


def _bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` documents of ``labels`` (id, label), picked by hash.

    Rows that repeat an id train once, by the smallest of their features."""
    known = labels.where("id is not null and label in (0, 1)").dropDuplicates(["id"])
    picked = F.broadcast(known.orderBy(F.xxhash64(F.lit(51), "id"), "id").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            found = [features(v.as_py(), ids) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "label", "f"]
            )

    joined = _bytes(docs, key, text).join(picked, "id").select(F.col("id").cast("string").alias("id"), "label", "text")
    each = joined.mapInArrow(run, "id string, label int, f array<double>")
    found = each.groupBy("id", "label").agg(F.min("f").alias("f")).collect()
    found.sort(key=lambda r: (r["id"], r["label"], r["f"]))
    x = np.array([r["f"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return x, np.array([r["label"] for r in found], dtype=int)


def score_documents(docs: DataFrame, ranking: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            rows = np.array([features(v.as_py(), ids) for v in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.score(rows))], ["id", "score"])

    rows = _bytes(docs, key, text)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, all columns as they are."""

    # Python sees the texts alone, and gives a number for each; the rows themselves stay in Spark.
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = WordIds()
        for part in texts:
            rows = [features(v.as_py(), ids) for v in part]
            yield pa.array(ranking.score(np.array(rows).reshape(-1, len(FEATURES))))

    return docs.where(score(docs[text].cast("binary")) >= 0.5)
