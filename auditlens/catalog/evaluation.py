"""Reports, threshold sweeps and model evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from ..operators.centroid import centroid_detector
from ..operators.nearest import nearest_distance, nearest_detector, nearest_scores
from ..operators.sets import split_classes
from ..plans import detection
from ..plans.curves import bayes_learning_curve
from . import CATALOG
from .bayes_sql import sql_bayes
from .sets import sql_overlap
from .tables import (
    COMMANDS,
    LABELLED,
    REPORT_COLUMNS,
    SPACE,
    commands,
    labelled,
    report_rounded,
    rounded,
    sql_hash,
    sql_position,
    sql_report,
    sql_tfidf,
    table,
)

ANSWERS = """answers as (
  select event_id as id, case when event_type = 'error' then 1 else 0 end as label,
         case when value > 5 then 1 else 0 end as prediction from events)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("value") > 5).cast("int").alias("prediction"),
    )


@CATALOG.query(f"with {ANSWERS}, {sql_report('answers')} select {REPORT_COLUMNS} from report")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rounded(evaluation.classification_report(_answers(spark, sf_dir)))


@CATALOG.query(
    """with answers as (select l_returnflag as label, l_linestatus as prediction from lineitem),
    """
    + sql_report("answers")
    + f" select {REPORT_COLUMNS} from report"
)
def report_of_unseen_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and predictions share no class: every denominator case occurs."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("prediction")
    )
    return report_rounded(evaluation.classification_report(rows))


@CATALOG.query(
    f"with {ANSWERS} select round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy from answers"
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.accuracy(_answers(spark, sf_dir)), "accuracy")


@CATALOG.query(
    f"""with {ANSWERS}
    select count(*) filter (where label = 0 and prediction = 0) as tp,
           count(*) filter (where label = 0 and prediction = 1) as fn,
           count(*) filter (where label = 1 and prediction = 0) as fp,
           count(*) filter (where label = 1 and prediction = 1) as tn from answers"""
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_answers(spark, sf_dir))


SWEEP_MEASURES = (
    "normal_precision",
    "normal_recall",
    "normal_f1",
    "abnormal_precision",
    "abnormal_recall",
    "abnormal_f1",
    "accuracy",
)

SWEEP_COLUMNS = """bound_index, round(bound, 6) as bound, tp, fn, fp, tn,
  round(case when tp + fp = 0 then 0.0 else tp / (tp + fp) end, 6) as normal_precision,
  round(case when tp + fn = 0 then 0.0 else tp / (tp + fn) end, 6) as normal_recall,
  round(case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end, 6) as normal_f1,
  round(case when tn + fn = 0 then 0.0 else tn / (tn + fn) end, 6) as abnormal_precision,
  round(case when tn + fp = 0 then 0.0 else tn / (tn + fp) end, 6) as abnormal_recall,
  round(case when 2 * tn + fp + fn = 0 then 0.0 else 2 * tn / (2 * tn + fp + fn) end, 6) as abnormal_f1,
  round((tp + tn) / (tp + fn + fp + tn), 6) as accuracy"""


def sql_sweep(relation: str, bounds: str, count: int, abnormal: str) -> str:
    """CTE ``cells`` with the confusion counts per bound of ``relation`` under ``abnormal``."""
    return f"""bounds as (select i as bound_index, {bounds} as bound from range({count}) as b(i)),
    cells as (
      select bound_index, bound,
             count(*) filter (where label = 0 and not ({abnormal})) as tp,
             count(*) filter (where label = 0 and {abnormal}) as fn,
             count(*) filter (where label = 1 and not ({abnormal})) as fp,
             count(*) filter (where label = 1 and {abnormal}) as tn
      from {relation} cross join bounds group by all)"""


def _sweep_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, "bound", *SWEEP_MEASURES)


CENTROID_GRID = """case when i = 299 then 1.2::double
  else 0.8::double + (1.2::double - 0.8::double) / 299 * i end"""


UNKNOWN = "chr(0) || 'unknown'"


def sql_encoded(text: str) -> str:
    return f"""list_transform(string_split({text}, ' '),
      lambda x: case when x = '' or regexp_matches(x, '{SPACE}') then {UNKNOWN} else x end)"""


SQL_NEAREST = f"""{COMMANDS},
    normals as (select distinct command from commands where label = 0),
    abnormals as (select distinct command from commands where label = 1),
    test_normal as (select command from normals qualify {sql_position('command')} <= 500),
    test_abnormal as (select command from abnormals qualify {sql_position('command')} <= 500),
    train as (select command from normals except select command from test_normal),
    words as (select distinct unnest(list_filter(string_split_regex(command, '{SPACE}+'), lambda x: x <> '')) as w
              from commands),
    tests as (
      select row_number() over () as id, command, label, {sql_encoded('command')} as t
      from (select command, 0 as label from test_normal union all select command, 1 from test_abnormal)),
    base as (
      select row_number() over () as id, t from (
        select {sql_encoded('trim(command)')} as t from train where command <> ''
        union all
        select [case when s in (select w from words) then s else {UNKNOWN} end]
        from (select unnest(['readlink', 'grep', 'top', 'jstat']) as s))),
    {sql_overlap('tests', 'base')},
    scores as (select command, label, numerator, denominator from nearest join tests using (id))"""


@CATALOG.query(
    f"""with {SQL_NEAREST}
    select md5(command) as command, label, round(numerator / denominator, 6) as distance from scores"""
)
def nearest_detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = (side.select("command").distinct() for side in split_classes(commands(spark, sf_dir)))
    scores = nearest_scores(normal, abnormal)
    return rounded(scores.select(F.md5("command").alias("command"), "label", "distance"), "distance")


@CATALOG.query(
    f"""with {SQL_NEAREST},
    {sql_sweep('scores', '(8 + i) / 40.0', 21, 'numerator * 40 > (8 + bound_index) * denominator')}
    select {SWEEP_COLUMNS} from cells"""
)
def nearest_detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = (side.select("command").distinct() for side in split_classes(commands(spark, sf_dir)))
    return _sweep_rounded(nearest_detector(normal, abnormal))


@CATALOG.query(
    f"""with {LABELLED},
    tests as (select conv_id * 1000 + turn as id, cast(turn % 2 as integer) as label, string_split(text, ' ') as t
              from conversations),
    base as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 0),
    {sql_overlap('tests', 'base')},
    scores as (select label, numerator, denominator from nearest join tests using (id)),
    {sql_sweep('scores', '(8 + i) / 40.0', 21, 'numerator * 40 > (8 + bound_index) * denominator')}
    select {SWEEP_COLUMNS} from cells"""
)
def fraction_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("cmd_id"),
        (F.col("turn") % 2).cast("int").alias("label"),
        F.col("text").alias("command"),
    )
    normal, _ = split_classes(labelled(spark, sf_dir))
    scored = tests.select("cmd_id", "label").join(nearest_distance(tests, normal), "cmd_id")
    return _sweep_rounded(evaluation.sweep_fraction(scored))


SQL_CENTROID = f"""{LABELLED}, normals as (select * from labelled where label = 0),
    {sql_tfidf('normals', 'labelled')},
    centre as (select term, sum(weight) / (select count(*) from normals) as c from tfidf where label = 0 group by term),
    distances as (
      select l.cmd_id, l.label,
             sqrt(greatest(coalesce(sum(weight * weight), 0) - 2 * coalesce(sum(weight * c), 0)
                           + (select sum(c * c) from centre), 0)) as distance
      from labelled l left join tfidf t using (cmd_id) left join centre using (term) group by l.cmd_id, l.label)"""


@CATALOG.query(
    f"""with {SQL_CENTROID},
    {sql_sweep('distances', CENTROID_GRID, 300, 'distance >= bound')}
    select {SWEEP_COLUMNS} from cells where tp + fp > 0 and tp + fn > 0 and tn + fn > 0 and tn + fp > 0"""
)
def centroid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep_rounded(centroid_detector(labelled(spark, sf_dir)))


@CATALOG.query(
    f"""with scores as (select case when event_type = 'error' then 1 else 0 end as label, value / 10 as distance from events),
    {sql_sweep('scores', CENTROID_GRID, 300, 'distance >= bound')}
    select {SWEEP_COLUMNS} from cells where tp + fp > 0 and tp + fn > 0 and tn + fn > 0 and tn + fp > 0"""
)
def score_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select(
        (F.col("event_type") == "error").cast("int").alias("label"), (F.col("value") / 10).alias("distance")
    )
    return _sweep_rounded(evaluation.sweep_score(scores))


@CATALOG.query(
    f"""with {LABELLED},
    folded as (select *, ntile(5) over (order by md5('0|' || cmd_id), cmd_id) - 1 as fold from labelled),
    train as (select f, cmd_id, command, label from folded join range(5) as r(f) on fold <> f),
    test as (select fold as f, cmd_id, command, label from folded),
    {sql_bayes('train', 'test')}
    select f as fold, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as score
    from bayes group by f"""
)
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detection.cross_val_score(detection.bayes, labelled(spark, sf_dir)), "score")


@CATALOG.query(
    f"""with {LABELLED},
    train as (select 0 as f, * from labelled where {sql_hash('cmd_id', 42)} >= {int(0.2 * (1 << 32))}),
    heads as (select command as head, {sql_position('cmd_id', '0-normal')} as i from labelled where label = 0
              qualify i <= 100),
    tails as (select command as tail, {sql_position('cmd_id', '0-abnormal')} as j from labelled where label = 1
              qualify j <= 100),
    test as (
      select 0 as f, (i - 1) * 100 + j as cmd_id, 1 as label,
             head || (['|', '||', '&&', ';'])[1 + {sql_hash("i || '|' || j")} % 4] || tail as command
      from heads cross join tails),
    {sql_bayes('train', 'test')},
    {sql_report('bayes')}
    select 'bayes' as detector, {REPORT_COLUMNS} from report"""
)
def injection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rounded(detection.injection_report(labelled(spark, sf_dir), {"bayes": detection.bayes}))


@CATALOG.query()
def injection_report_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rounded(detection.injection_report(labelled(spark, sf_dir)))


@CATALOG.query(
    f"""with {LABELLED},
    runs as (select s * 5 + z as f, s, ([0.1, 0.325, 0.55, 0.775, 1.0])[z + 1] as size
             from range(10) as a(s), range(5) as b(z)),
    sides as (
      select f, s, size, cmd_id, command, label,
             case when {sql_hash("s || '|' || cmd_id")} < {int(0.2 * (1 << 32))} then 'test' else 'train' end as side,
             {sql_hash("s || '|' || cmd_id", '0-size')} < cast(size * {1 << 32} as bigint) as inside
      from labelled cross join runs),
    train as (select f, cmd_id, command, label from sides where side = 'train' and inside),
    test as (select f, cmd_id, command, label from sides where side = 'test' or inside),
    {sql_bayes('train', 'test')},
    scores as (
      select size, side, f, avg(case when bayes.label = prediction then 1.0 else 0.0 end) as score
      from bayes join sides using (f, cmd_id) group by all)
    select cast(size as double) as train_size, side, round(avg(score), 6) as mean_score,
           round(stddev_pop(score), 6) as std_score
    from scores group by all"""
)
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five train sizes on ten splits, all fifty runs in one pass."""
    curve = bayes_learning_curve(labelled(spark, sf_dir))
    return rounded(curve, "mean_score", "std_score")


@CATALOG.query(
    f"""with {LABELLED}
    select cmd_id, cast((row_number() over (order by md5('0|' || cmd_id), cmd_id) - 1) % 3 as integer) as fold
    from labelled"""
)
def grid_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds behind the grid search."""
    return detection.grid_folds(labelled(spark, sf_dir), 3).select("cmd_id", "fold")


@CATALOG.query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.grid_search(labelled(spark, sf_dir))


@CATALOG.query()
def text_outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-class SVM, isolation forest and local outlier factor on reduced TF-IDF."""
    return report_rounded(detection.text_outlier_report(labelled(spark, sf_dir)))


@CATALOG.query(
    f"""with {LABELLED}, n as (
      select count(*) as n, count(*) filter (where label = 0) as m from labelled)
    select 'isolation_forest' as detector, cast(ceil((n - 1) * 0.19) as bigint) as outliers from n
    union all
    select 'one_class_svm', cast(ceil((m - 1) * 0.002) as bigint) from n"""
)
def text_outliers_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts two detectors call abnormal, of all and of those they were fitted on: the shares
    asked for, as no scores tie at the cut."""
    found = detection.text_outliers(labelled(spark, sf_dir)).where("prediction = -1")
    counted = (F.col("detector") == "isolation_forest") | (
        (F.col("detector") == "one_class_svm") & (F.col("label") == 1)
    )
    return found.where(counted).groupBy("detector").agg(F.count("*").alias("outliers"))


@CATALOG.query()
def detector_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    detectors = {**detection.DETECTORS, "knn": detection.knn}
    return report_rounded(detection.compare_detectors(labelled(spark, sf_dir), detectors))
