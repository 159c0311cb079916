"""TF-IDF, singular values and explained variance."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tfidf
from ..operators.reduction import direction_residuals, explained_variance, svd_transform, truncated_svd
from ..operators.sets import split_classes
from ..plans.detection import text_vectors
from ..session import stored
from . import CATALOG
from .tables import COMMANDS, LABELLED, WORD, commands, labelled, rounded, sql_tfidf, vectors


@CATALOG.query(
    f"""with {COMMANDS} select cmd_id, term, count(*) as tf
    from (select cmd_id, unnest(regexp_extract_all(lower(command), '{WORD}')) as term from commands)
    group by all"""
)
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.term_counts(commands(spark, sf_dir))


@CATALOG.query(
    f"""with {COMMANDS} select term, count(distinct cmd_id) as df
    from (select cmd_id, unnest(regexp_extract_all(lower(command), '{WORD}')) as term from commands)
    group by term"""
)
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.document_frequencies(commands(spark, sf_dir))


@CATALOG.query(f"with {COMMANDS}, {sql_tfidf('commands')} select term, df, round(idf, 6) as idf from idf")
def tfidf_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tfidf.tfidf_fit(commands(spark, sf_dir)).terms, "idf")


@CATALOG.query(
    f"with {COMMANDS}, {sql_tfidf('commands')} select cmd_id, term, round(weight, 6) as weight from tfidf"
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commands(spark, sf_dir)
    return rounded(tfidf.tfidf_transform(rows, tfidf.tfidf_fit(rows)), "weight")


NORMALS = "normals as (select * from labelled where label = 0)"


@CATALOG.query(
    f"""with {LABELLED}, {NORMALS}, {sql_tfidf('normals', 'labelled')}
    select cmd_id, term, round(weight, 6) as weight from tfidf"""
)
def tfidf_of_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    normal, _ = split_classes(rows)
    return rounded(tfidf.tfidf_transform(rows, tfidf.tfidf_fit(normal)), "weight")


@CATALOG.query(
    """select cast(64 as bigint) as k, round(sum(x * x), 4) as energy
    from (select unnest(cast(embedding as double[])) as x from embeddings)"""
)
def singular_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All squared singular values together are the sum of all squared entries."""
    rows = vectors(spark, sf_dir).select(array_to_vector("features").alias("features"))
    singular = truncated_svd(rows, 64).singular
    found = [(len(singular), float((singular**2).sum()))]
    return rounded(spark.createDataFrame(found, "k long, energy double"), "energy", digits=4)


@CATALOG.query(
    """select vec_id as id, round(sqrt(sum(x * x)), 6) as length
    from (select vec_id, unnest(cast(embedding as double[])) as x from embeddings) group by vec_id"""
)
def rotated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on all 64 directions keep the length of every row."""
    rows = vectors(spark, sf_dir).select("id", array_to_vector("features").alias("features"))
    reduced = svd_transform(rows, truncated_svd(rows.select("features"), 64))
    length = F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x))
    return rounded(reduced.select("id", length.alias("length")), "length")


@CATALOG.query(
    """select cast(64 as bigint) as k, round(sum(v), 6) as variance, 1.0::double as explained from (
      select var_pop(x) as v from (
        select unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by i)"""
)
def variance_of_all_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On all 64 directions the coordinates carry the variance of all columns."""
    model = truncated_svd(vectors(spark, sf_dir).select(array_to_vector("features").alias("features")), 64)
    found = [(len(model.variance), float(model.variance.sum()), float(model.ratio.sum()))]
    return rounded(spark.createDataFrame(found, "k long, variance double, explained double"), "variance", "explained")


@CATALOG.query(
    """with p as (select cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
    m as (select sum(x * x) as a, sum(x * y) as b, sum(y * y) as c from p),
    e as (select (a + c) / 2 as mid, sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as half,
                 0.5 * atan2(2 * b, a - c) as angle from m),
    v as (select 1 as direction, sqrt(mid + half) as singular, cos(angle) as x, sin(angle) as y from e
          union all select 2, sqrt(mid - half), -sin(angle), cos(angle) from e)
    select cast(direction as bigint) as direction, round(singular, 6) as singular,
           round(x * s, 4) as x, round(y * s, 4) as y
    from (select *, sign(case when abs(x) >= abs(y) then x else y end) as s from v)"""
)
def directions_of_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values and directions of a two-column matrix, whose closed form SQL can say."""
    pairs = vectors(spark, sf_dir).select(array_to_vector(F.slice("features", 1, 2)).alias("features"))
    model = truncated_svd(pairs, 2)
    found = [
        (i + 1, float(model.singular[i]), float(model.components[0, i]), float(model.components[1, i])) for i in range(2)
    ]
    frame = spark.createDataFrame(found, "direction long, singular double, x double, y double")
    return rounded(rounded(frame, "singular"), "x", "y", digits=4)


@CATALOG.query(
    """select cast(i as bigint) as i, cast(j as bigint) as j, case when i = j then 1.0 else 0.0 end::double as product
    from range(5) as a(i) cross join range(5) as b(j)"""
)
def coordinate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on 5 of 64 directions: their cross products over all rows are 0, their squares singular squared."""
    rows = vectors(spark, sf_dir).select("id", array_to_vector("features").alias("features"))
    model = truncated_svd(rows.select("features"), 5)
    reduced = svd_transform(rows, model)
    each = F.inline(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(4)),
                lambda i: F.transform(
                    F.sequence(F.lit(0), F.lit(4)),
                    lambda j: F.struct(
                        i.cast("bigint").alias("i"),
                        j.cast("bigint").alias("j"),
                        (F.get("reduced", i) * F.get("reduced", j)).alias("p"),
                    ),
                ),
            )
        )
    )
    scale = F.array(*[F.lit(float(s)) for s in model.singular])
    sums = reduced.select(each).groupBy("i", "j").agg(F.sum("p").alias("p"))
    product = F.col("p") / F.get(scale, F.col("i").cast("int")) / F.get(scale, F.col("j").cast("int"))
    return rounded(sums.select("i", "j", product.alias("product")), "product", digits=4)


@CATALOG.query(
    """with columns as (
      select sum(x * x) as energy from (
        select unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by i),
    bounds as (select count(*) as width, sum(energy) as total, max(energy) as highest from columns)
    select cast(d as bigint) as direction, 0.0::double as residual, true as between_bounds
    from bounds, range(1, 6) as r(d)"""
)
def singular_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of 64 directions at the defaults, tested on the rows: X.T X v - s^2 v is 0, so a basis that is not
    singular shows; the first direction has no less energy than any column, all five no more than all columns,
    and no less than an equal part."""
    rows = vectors(spark, sf_dir).select(array_to_vector("features").alias("features"))
    found = direction_residuals(rows, truncated_svd(rows, 5))
    sums = vectors(spark, sf_dir).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    bounds = sums.agg(F.count("*").alias("width"), F.sum("e").alias("total"), F.max("e").alias("highest"))
    five = found.agg(F.sum("energy").alias("five"), F.max("energy").alias("first"))
    slack = 1 + 1e-9
    inside = (
        (F.col("first") * slack >= F.col("highest"))
        & (F.col("five") <= F.col("total") * slack)
        & (F.col("five") * F.col("width") * slack >= F.col("total") * 5)
    )
    checked = bounds.join(F.broadcast(five), F.lit(True)).select(inside.alias("between_bounds"))
    named = found.join(F.broadcast(checked), F.lit(True)).select("direction", "residual", "between_bounds")
    return rounded(named, "residual", digits=2)


@CATALOG.query()
def explained_variance_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = text_vectors(commands(spark, sf_dir), keep=()).select(array_to_vector("features").alias("features"))
    return explained_variance(features, list(range(100, 600, 100)))


@CATALOG.query()
def reduced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(text_vectors(commands(spark, sf_dir)), "text-vectors")
    features = rows.withColumn("features", array_to_vector("features"))
    return svd_transform(features, truncated_svd(features.select("features"), 400))
