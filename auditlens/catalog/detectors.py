"""Detectors on documents and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import LEXICAL_COLUMNS, lexical_features
from ..functions.text import substr_count
from ..operators import classifiers, neighbours, tfidf
from ..operators.bayes import bayes_fit, bayes_scores
from ..operators.centroid import centroid_distance, centroid_fit
from ..operators.discriminant import discriminant_fit, lda_classify
from ..operators.evaluation import classification_report
from ..operators.isolation import isolation_forest, tree_samples
from ..operators.oneclass import one_class_fit, one_class_score
from ..operators.projection import project_terms
from ..operators.quantile import contamination_cut
from ..operators.reduction import svd_transform, truncated_svd
from ..operators.sampling import train_test_split
from ..operators.sets import split_classes
from ..plans import detection
from ..session import scratch_path, stored
from . import CATALOG
from .bayes_sql import sql_bayes
from .evaluation import SQL_CENTROID
from .isolation_sql import sql_forest
from .tables import (
    LABELLED,
    REPORT_COLUMNS,
    VECTORS,
    labelled,
    report_rounded,
    rounded,
    sql_hash,
    sql_report,
    sql_tfidf,
    table,
    vectors,
)
from .text import audit_records, sql_lexical

IS_TEST = f"{sql_hash('cmd_id', 42)} < {int(0.2 * (1 << 32))}"
IS_TEST_VECTOR = f"{sql_hash('id', 42)} < {int(0.2 * (1 << 32))}"


SQL_KNN_TEXT = f"""train as (select * from labelled where not ({IS_TEST})),
    {sql_tfidf('train', 'labelled')},
    pairs as (
      select a.cmd_id, b.cmd_id as neighbour, sum(a.weight * b.weight) as dot
      from tfidf a join tfidf b using (term)
      where a.cmd_id in (select cmd_id from labelled where {IS_TEST})
        and b.cmd_id in (select cmd_id from train) group by all),
    sizes as (select cmd_id, label, coalesce(sum(weight * weight), 0) as own
              from labelled left join tfidf using (cmd_id, label) group by all),
    near as (
      select a.cmd_id, b.label, sqrt(greatest(a.own + b.own - 2 * coalesce(dot, 0), 0)) as distance
      from sizes a cross join sizes b left join pairs on pairs.cmd_id = a.cmd_id and neighbour = b.cmd_id
      where a.cmd_id in (select cmd_id from labelled where {IS_TEST}) and b.cmd_id in (select cmd_id from train)
      qualify row_number() over (partition by a.cmd_id order by round(distance, 6), b.cmd_id) <= 3),
    knn as (
      select cmd_id, cast(label as integer) as prediction from (
        select cmd_id, label, count(*) as votes from near group by all)
      qualify row_number() over (partition by cmd_id order by votes desc, label) = 1)"""


@CATALOG.query(f"with {LABELLED}, {SQL_KNN_TEXT} select cmd_id, prediction from knn")
def knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(labelled(spark, sf_dir), 0.2, "cmd_id")
    model = tfidf.tfidf_fit(train)
    sides = [tfidf.tfidf_vectors(rows, model, keep=("label",)) for rows in (train, test)]
    return neighbours.knn_classify(sides[0], sides[1], 3, "cmd_id")


def sql_vector_pairs(left: str, right: str) -> str:
    return f"""pairs as (
      select a.id, b.id as neighbour, b.label, list_distance(a.features, b.features) as distance
      from (select * from vectors where {left}) a cross join (select * from vectors where {right}) b)"""


@CATALOG.query(
    f"""with {VECTORS}, {sql_vector_pairs(IS_TEST_VECTOR, f'not ({IS_TEST_VECTOR})')},
    near as (select * from pairs
             qualify row_number() over (partition by id order by round(distance, 9), neighbour) <= 5)
    select id, cast(label as integer) as prediction from (select id, label, count(*) as votes from near group by all)
    qualify row_number() over (partition by id order by votes desc, label) = 1"""
)
def knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(vectors(spark, sf_dir), 0.2, "id")
    return neighbours.knn_classify(train, test, 5)


@CATALOG.query(
    f"""with {VECTORS}, {sql_vector_pairs('true', 'true')}
    select id, neighbour, round(distance, 6) as distance, rank from (
      select *, cast(row_number() over (partition by id order by round(distance, 9), neighbour) as integer) as rank
      from pairs where id <> neighbour) where rank <= 10"""
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    near = neighbours.k_nearest(rows, rows, 10, skip_self=True).drop("label")
    return rounded(near, "distance")


@CATALOG.query(
    f"""with {VECTORS}, {sql_vector_pairs(IS_TEST_VECTOR, f'not ({IS_TEST_VECTOR})')},
    votes as (select id, label, count(*) as n from pairs where round(distance, 9) <= 1.3 group by all),
    winner as (select id, label from votes
               qualify row_number() over (partition by id order by n desc, label) = 1)
    select v.id, cast(w.label as integer) as prediction
    from (select id from vectors where {IS_TEST_VECTOR}) v left join winner w on w.id = v.id"""
)
def radius_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(vectors(spark, sf_dir), 0.2, "id")
    return neighbours.radius_classify(train, test, 1.3)


@CATALOG.query(
    f"""with {LABELLED}, winner as (
      select label from labelled where not ({IS_TEST}) group by label order by count(*) desc, label limit 1)
    select cmd_id, (select label from winner) as prediction from labelled where {IS_TEST}"""
)
def radius_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF vectors and the published radius, which takes in every row: their lengths are measured."""
    train, test = train_test_split(labelled(spark, sf_dir), 0.2, "cmd_id")
    model = tfidf.tfidf_fit(train)
    sides = [stored(tfidf.tfidf_vectors(rows, model, keep=("label",)), "vectors") for rows in (train, test)]
    return neighbours.radius_classify(sides[0], sides[1], 500.0, "cmd_id")


@CATALOG.query(
    f"""with {LABELLED},
    train as (select 0 as f, * from labelled where not ({IS_TEST})),
    test as (select 0 as f, * from labelled where {IS_TEST}),
    {sql_bayes('train', 'test')}
    select cmd_id, label, round(log_p_0, 6) as log_p_0, round(log_p_1, 6) as log_p_1, prediction from bayes"""
)
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(labelled(spark, sf_dir), 0.2, "cmd_id")
    return rounded(bayes_scores(test, bayes_fit(train), keep=("label",)), "log_p_0", "log_p_1")


@CATALOG.query(f"with {SQL_CENTROID} select cmd_id, label, round(distance, 6) as distance from distances")
def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    normal, _ = split_classes(rows)
    return rounded(centroid_distance(rows, centroid_fit(normal), keep=("label",)), "distance")


@CATALOG.query(
    f"""with {VECTORS}, {sql_vector_pairs('true', 'true')},
    near as (select id, neighbour, distance from pairs where id <> neighbour
             qualify row_number() over (partition by id order by round(distance, 9), neighbour) <= 20),
    radius as (select id as neighbour, max(distance) as k_distance from near group by id),
    density as (select id, 1 / (avg(greatest(distance, k_distance)) + 1e-10) as lrd
                from near join radius using (neighbour) group by id),
    factors as (select near.id, avg(other.lrd) / any_value(own.lrd) as lof
                from near join density other on other.id = neighbour join density own on own.id = near.id
                group by near.id)
    select id, round(lof, 4) as lof,
           case when -lof < (select quantile_cont(-lof, 0.19) from factors) then -1 else 1 end as prediction
    from factors"""
)
def local_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = neighbours.local_outlier_factor(vectors(spark, sf_dir), 20)
    return rounded(contamination_cut(scored, 0.19).select("id", "lof", "prediction"), "lof", digits=4)


@CATALOG.query(
    """with scores as (select l_orderkey, l_linenumber, cast(l_extendedprice as double) as score from lineitem)
    select l_orderkey, l_linenumber,
           case when score < (select quantile_cont(score, 0.3757) from scores) then -1 else 1 end as prediction
    from scores"""
)
def contamination_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("score")
    )
    return contamination_cut(scores, 0.3757).drop("score")


@CATALOG.query(
    f"""with {VECTORS},
    entries as (select id, label, unnest(range(64)) as i, unnest(features) as x from vectors),
    means as (select label, i, avg(x) as mean from entries group by all),
    centred as (select id, i, x - mean as x from entries join means using (label, i))
    select cast(a.i as bigint) as i, cast(b.i as bigint) as j,
           round(sum(a.x * b.x) / ((select count(*) from vectors) - 2), 6) + 0.0 as covariance
    from centred a join centred b using (id) group by a.i, b.i"""
)
def pooled_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    covariance = discriminant_fit(vectors(spark, sf_dir)).covariance
    cells = [(i, j, float(v)) for i, row in enumerate(covariance) for j, v in enumerate(row)]
    return rounded(spark.createDataFrame(cells, "i long, j long, covariance double"), "covariance")


@CATALOG.query(
    f"""with {LABELLED},
    points as (
      select cmd_id, label, {IS_TEST} as is_test, length(command) / 1000.0::double as x,
             cast(length(command) - length(replace(command, '.', '')) as double) / 10 as y from labelled),
    train as (select * from points where not is_test),
    means as (select label, count(*) as n, avg(x) as mx, avg(y) as my from train group by label),
    pooled as (
      select sum((x - mx) * (x - mx)) / (count(*) - 2) as sxx, sum((x - mx) * (y - my)) / (count(*) - 2) as sxy,
             sum((y - my) * (y - my)) / (count(*) - 2) as syy
      from train join means using (label)),
    weights as (
      select label, mx, my, (syy * mx - sxy * my) / (sxx * syy - sxy * sxy) as wx,
             (sxx * my - sxy * mx) / (sxx * syy - sxy * sxy) as wy,
             ln(n / (select count(*) from train)) as prior
      from means cross join pooled),
    scores as (
      select cmd_id, p.label, w.label as class, x * wx + y * wy - (mx * wx + my * wy) / 2 + prior as score
      from points p cross join weights w where is_test),
    pairs as (
      select cmd_id, label, max(score) filter (where class = 0) as s0, max(score) filter (where class = 1) as s1
      from scores group by all)
    select cmd_id, label, round(s1 - s0, 6) + 0.0 as margin, case when s1 > s0 then 1 else 0 end as prediction
    from pairs"""
)
def discriminant_of_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features, so that SQL can invert the covariance."""
    points = labelled(spark, sf_dir).select(
        "cmd_id",
        "label",
        F.array(F.length("command") / 1000.0, substr_count(F.col("command"), ".") / 10).alias("features"),
    )
    train, test = train_test_split(points, 0.2, "cmd_id")
    scored = lda_classify(train, test).withColumn("margin", F.col("scores")[1] - F.col("scores")[0])
    return rounded(scored.select("cmd_id", "label", "margin", "prediction"), "margin")


@CATALOG.query()
def linear_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(vectors(spark, sf_dir), 0.2, "id")
    return report_rounded(classification_report(lda_classify(train, test)))


@CATALOG.query()
def discriminant_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    """TF-IDF and SVD are fitted on the train side."""
    train, test = train_test_split(rows, 0.2, "cmd_id")
    model = tfidf.tfidf_fit(train)

    def vectors_of(part: DataFrame) -> DataFrame:
        projected = project_terms(tfidf.tfidf_vectors(part, model, keep=("label",)), 1024)
        return projected.withColumn("features", array_to_vector("features"))

    seen = stored(vectors_of(train), "train-vectors")
    directions = truncated_svd(seen.select("features"), 100)
    sides = [svd_transform(side, directions) for side in (seen, vectors_of(test))]
    return report_rounded(classification_report(lda_classify(*sides, "reduced")))


@CATALOG.query()
def one_class_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    normal, _ = split_classes(rows)
    return one_class_score(rows, one_class_fit(normal)).select("id", "label", "score", "prediction")


@CATALOG.query(
    """with h as (
      select vec_id as id, md5('42|' || vec_id) as d from embeddings),
    p as (
      select t as tree, id, (cast('0x' || substring(d, 1, 8) as bigint) + t * cast('0x' || substring(d, 9, 8) as bigint))
             % 4294967296 as place from h cross join range(100) as r(t)),
    q as (select tree, id, row_number() over (partition by tree order by place, id) as rank from p)
    select cast(tree as integer) as tree, id from q where rank <= 64"""
)
def isolation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows each tree of a forest sees."""
    return tree_samples(vectors(spark, sf_dir), 100, 64, seed=42)


@CATALOG.query("select cast(ceil((count(*) - 1) * 0.19) as bigint) as outliers from embeddings")
def isolation_outliers_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows called abnormal is the contamination."""
    scored = isolation_forest(vectors(spark, sf_dir), 100, 5000, 0.19, seed=42)
    return scored.agg(F.count_if(F.col("prediction") == -1).alias("outliers"))


@CATALOG.query(
    f"""with {VECTORS}, points as (select id, features as x from vectors), {sql_forest(100, 5000, 42, 0.19)}
    select id, label, round(score, 9) as score, prediction from scored join vectors using (id)"""
)
def isolation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = isolation_forest(vectors(spark, sf_dir), 100, 5000, 0.19, seed=42)
    return rounded(scored.select("id", "label", "score", "prediction"), "score", digits=9)


@CATALOG.query(
    f"""with counted as ({sql_lexical("doc_id as id, c")}),
    points as (select id, [{", ".join(LEXICAL_COLUMNS)}] as x from counted), {sql_forest(200, 256, 0, 0.3757)}
    select id, c as ccmdline, round(score, 9) as score from scored join counted using (id) where prediction = -1"""
)
def isolation_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest on the 22 lexical counters: the abnormal commands."""
    rows = audit_records(spark, sf_dir).withColumn("id", F.col("cpid").cast("bigint"))
    features = lexical_features(rows).select(
        "id", "ccmdline", F.array(*[F.col(c) for c in LEXICAL_COLUMNS]).alias("features")
    )
    scored = isolation_forest(features, 200, 256, 0.3757)
    return rounded(scored.where("prediction = -1").select("id", "ccmdline", "score"), "score", digits=9)


@CATALOG.query()
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(labelled(spark, sf_dir), 0.2, "cmd_id")
    return report_rounded(classification_report(classifiers.predict(classifiers.decision_tree(train), test)))


@CATALOG.query(
    f"""with {LABELLED}, sides as (
      select label from labelled where {sql_hash('cmd_id', 42)} < {int(0.2 * (1 << 32))})
    select detector, label, count(*) as support from sides cross join (values ('svm'), ('tree')) as d(detector)
    group by all"""
)
def supports_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test row is answered once by the tree and by the SVM."""
    train, test = train_test_split(labelled(spark, sf_dir), 0.2, "cmd_id")
    tree = classifiers.predict(classifiers.decision_tree(train), test).withColumn("detector", F.lit("tree"))
    svm = classifiers.rbf_svm_predict(classifiers.rbf_svm(train), test).withColumn("detector", F.lit("svm"))
    answers = tree.unionByName(svm).where("prediction in (0, 1)")
    return answers.groupBy("detector", "label").agg(F.count("*").alias("support"))


@CATALOG.query()
def rbf_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(labelled(spark, sf_dir), 0.2, "cmd_id")
    return report_rounded(classification_report(classifiers.rbf_svm_predict(classifiers.rbf_svm(train), test)))


@CATALOG.query()
def bagged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble, saved and loaded again; chunk and step follow the size of the table."""
    rows = labelled(spark, sf_dir)
    normal, abnormal = split_classes(rows)
    step = max(1, normal.count() // 3)
    path = scratch_path(spark, "ensemble")
    classifiers.save_models(classifiers.bagged_trees(normal, abnormal, chunk=step // 2, step=step), path)
    answers = classifiers.ensemble_predict(classifiers.load_models(spark, path), rows)
    return report_rounded(classification_report(answers))


@CATALOG.query(
    f"""with {LABELLED}
    select count(*) as rows, cast(0 as bigint) as differing from labelled"""
)
def saved_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble answers the same after saving and loading."""
    rows = labelled(spark, sf_dir)
    normal, abnormal = split_classes(rows)
    step = max(1, normal.count() // 2)
    models = classifiers.bagged_trees(normal, abnormal, chunk=step // 2, step=step)
    path = scratch_path(spark, "ensemble")
    classifiers.save_models(models, path)
    first = classifiers.ensemble_predict(models, rows).withColumnRenamed("prediction", "first")
    again = classifiers.ensemble_predict(classifiers.load_models(spark, path), rows).select("cmd_id", "prediction")
    return first.join(again, "cmd_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("first") != F.col("prediction")).alias("differing")
    )


def _sql_report_of(relation: str) -> str:
    return f"(with {sql_report(relation)} select {REPORT_COLUMNS} from report)"


@CATALOG.query(
    f"""with {LABELLED}, {SQL_KNN_TEXT},
    fit_rows as (select 0 as f, * from train),
    test_rows as (select 0 as f, * from labelled where {IS_TEST}),
    {sql_bayes('fit_rows', 'test_rows')},
    knn_rows as (select l.label, knn.prediction from knn join labelled l using (cmd_id))
    select 'bayes' as detector, * from {_sql_report_of('bayes')}
    union all
    select 'knn', * from {_sql_report_of('knn_rows')}"""
)
def comparison_of_exact_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors that SQL can follow, on one split."""
    detectors = {"bayes": detection.bayes, "knn": detection.knn}
    return report_rounded(detection.compare_detectors(labelled(spark, sf_dir), detectors))
