"""Classification reports and threshold sweeps, each from one small aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CENTROID_BOUNDS, NORMAL


def linspace(first: float, last: float, count: int) -> list[float]:
    """Evenly spaced values, both ends included."""
    step = (last - first) / (count - 1)
    return [first + step * i for i in range(count - 1)] + [last]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, class, precision, recall, f1, support)`` with the rows accuracy, macro avg and
    weighted avg. A zero denominator gives 0. The data is reduced to the confusion counts first.
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(label).alias("l"), F.col(prediction).alias("p")).agg(
        F.count("*").alias("n")
    )
    sides = pairs.select(
        *by,
        "l",
        "p",
        "n",
        F.explode(F.array_distinct(F.array("l", "p"))).alias("class"),
    )
    hit, said = F.col("l") == F.col("class"), F.col("p") == F.col("class")
    per_class = sides.groupBy(*by, "class").agg(
        F.sum(F.when(hit & said, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(said, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("support"),
    )
    scored = (
        per_class.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn(
            "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = scored.groupBy(*by).agg(
        total.alias("support"),
        _ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures],
    )

    def row(name: str, values: Sequence[Column]) -> Column:
        fields = [v.cast("double").alias(m) for v, m in zip(values, measures, strict=True)]
        return F.struct(F.lit(name).alias("class"), *fields, F.col("support").cast("bigint").alias("support"))

    extra = F.array(
        row("accuracy", [F.lit(None), F.lit(None), F.col("accuracy")]),
        row("macro avg", [F.col(f"macro_{m}") for m in measures]),
        row("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
    )
    return scored.select(
        *by, F.col("class").cast("string").alias("class"), *measures, F.col("support").cast("bigint").alias("support")
    ).unionByName(summary.select(*by, F.explode(extra).alias("r")).select(*by, "r.*"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(accuracy)``."""
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = NORMAL
) -> DataFrame:
    """``(tp, fn, fp, tn)`` with the normal class as the positive one."""
    is_pos, said_pos = F.col(label) == positive, F.col(prediction) == positive

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0)).alias(name)

    return df.agg(
        total(is_pos & said_pos, "tp"),
        total(is_pos & ~said_pos, "fn"),
        total(~is_pos & said_pos, "fp"),
        total(~is_pos & ~said_pos, "tn"),
    )


def bounds_below(score: Column, bounds: Sequence[float], strict: bool) -> Column:
    """How many of the ascending, evenly spaced bounds lie below the score.

    ``strict`` counts bound < score, otherwise bound <= score. The position is computed and
    checked against the neighbouring bounds, so the answer is exact and costs the same for any
    number of bounds.
    """
    first, step = bounds[0], (bounds[-1] - bounds[0]) / (len(bounds) - 1)
    grid = F.array(*[F.lit(float(b)) for b in bounds])
    # The clamp comes before the cast, so that far-off scores stay inside the grid.
    place = F.floor((score - first) / step).cast("double")
    guess = F.greatest(F.lit(0.0), F.least(place, F.lit(float(len(bounds)))))
    low = F.greatest(guess.cast("int") - 1, F.lit(0))
    near = F.slice(grid, low + 1, 4)
    passed = F.size(F.filter(near, lambda b: b < score if strict else b <= score))
    return low + passed


def sweep_counts(df: DataFrame, passed: Column, n_bounds: int, label: str = "label") -> DataFrame:
    """``(bound_index, label, above, below)`` for every bound from one aggregate.

    ``passed`` is the number of bounds a row exceeds. Rows are reduced to (label, passed) counts,
    at most classes x (bounds + 1), and only these are spread over the bounds.
    """
    cells = df.groupBy(F.col(label).alias("label"), passed.alias("passed")).agg(F.count("*").alias("n"))
    spread = cells.withColumn("bound_index", F.explode(F.sequence(F.lit(0), F.lit(n_bounds - 1))))
    exceeds = F.col("passed") > F.col("bound_index")
    return spread.groupBy("bound_index", "label").agg(
        F.sum(F.when(exceeds, F.col("n")).otherwise(0)).alias("above"),
        F.sum(F.when(exceeds, 0).otherwise(F.col("n"))).alias("below"),
    )


def _sweep_report(counts: DataFrame, bound: Column) -> DataFrame:
    """Precision, recall and F1 of both classes per bound; ``above`` means predicted abnormal."""

    def pick(label: int, column: str) -> Column:
        return F.sum(F.when(F.col("label") == label, F.col(column)).otherwise(0))

    cells = counts.groupBy("bound_index").agg(
        pick(0, "below").alias("tp"),
        pick(0, "above").alias("fn"),
        pick(1, "below").alias("fp"),
        pick(1, "above").alias("tn"),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return cells.select(
        F.col("bound_index").cast("bigint").alias("bound_index"),
        bound.alias("bound"),
        "tp",
        "fn",
        "fp",
        "tn",
        _ratio(tp, tp + fp).alias("normal_precision"),
        _ratio(tp, tp + fn).alias("normal_recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("normal_f1"),
        _ratio(tn, tn + fn).alias("abnormal_precision"),
        _ratio(tn, tn + fp).alias("abnormal_recall"),
        _ratio(2 * tn, 2 * tn + fp + fn).alias("abnormal_f1"),
        _ratio(tp + tn, tp + fn + fp + tn).alias("accuracy"),
    )


def sweep_fraction(
    df: DataFrame,
    numerator: str = "numerator",
    denominator: str = "denominator",
    label: str = "label",
    first: int = 8,
    steps: int = 21,
    scale: int = 40,
) -> DataFrame:
    """Report per bound (first + i) / scale, abnormal when numerator / denominator exceeds it.

    Integer arithmetic throughout, so a distance equal to a bound is never misjudged.
    """
    scaled, den = F.col(numerator) * scale, F.col(denominator)
    # Bounds below a fraction: the largest integer strictly under numerator * scale / denominator.
    under = F.floor((scaled - F.pmod(scaled - 1, den) - 1) / den).cast("bigint")
    passed = F.least(F.greatest(under - first + 1, F.lit(0)), F.lit(steps)).cast("int")
    return _sweep_report(
        sweep_counts(df, passed, steps, label), (F.col("bound_index") + first) / F.lit(float(scale))
    )


def sweep_score(
    df: DataFrame,
    score: str = "distance",
    label: str = "label",
    bounds: Sequence[float] | None = None,
    normal_when_equal: bool = False,
) -> DataFrame:
    """Report per bound, normal when score < bound; bounds with a zero denominator are left out.

    ``normal_when_equal`` counts score = bound as normal too.
    """
    grid = list(bounds) if bounds is not None else linspace(*CENTROID_BOUNDS)
    passed = bounds_below(F.col(score), grid, strict=normal_when_equal)
    value = F.get(F.array(*[F.lit(float(b)) for b in grid]), F.col("bound_index").cast("int"))
    report = _sweep_report(sweep_counts(df, passed, len(grid), label), value)
    return report.where("tp + fp > 0 and tp + fn > 0 and tn + fn > 0 and tn + fp > 0")
