"""Set algebra, class handling, counts and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DATASET_SEEDS
from ..functions.distance import ngram_distance, token_distance
from ..functions.text import tokens_strict
from ..operators import aggregates, sets
from ..operators.injection import inject
from ..operators.nearest import filter_by_distance, nearest_distance
from . import CATALOG
from .tables import (
    COMMANDS,
    LABELLED,
    LINES,
    PROCESS,
    commands,
    labelled,
    lines,
    process_commands,
    rounded,
    sql_hash,
    sql_position,
    table,
)


@CATALOG.query(
    f"""with {LINES} select label, count(*) as n, cast(sum(length(command)) as bigint) as characters
    from lines where command <> '' group by label"""
)
def class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.non_empty(lines(spark, sf_dir))
    normal, abnormal = sets.split_classes(rows)
    sides = [
        side.groupBy("label").agg(
            F.count("*").alias("n"), F.sum(F.length("command")).cast("bigint").alias("characters")
        )
        for side in (normal, abnormal)
    ]
    return sides[0].unionByName(sides[1])


@CATALOG.query(
    f"""with {LINES} select doc_id, pos, label from lines
    where label = 1 or command not in (select command from lines where label = 1)"""
)
def conflicts_keep_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.remove_conflicts(lines(spark, sf_dir), keep=1).select("doc_id", "pos", "label")


@CATALOG.query(
    f"""with {LINES} select doc_id, pos, label from lines
    where label = 0 or command not in (select command from lines where label = 0)"""
)
def conflicts_keep_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.remove_conflicts(lines(spark, sf_dir), keep=0).select("doc_id", "pos", "label")


@CATALOG.query(
    f"""with {LINES}
    select command from lines where label = 0 except select command from lines where label = 1"""
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = sets.split_classes(lines(spark, sf_dir))
    return sets.set_minus(normal.select("command"), abnormal.select("command"))


@CATALOG.query(
    "select text as command from benchmark union select text from documents union select text from conversations"
)
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        table(spark, sf_dir, name).select(F.col("text").alias("command"))
        for name in ("benchmark", "documents", "conversations")
    ]
    return sets.set_union(*frames)


@CATALOG.query(f"with {LINES} select distinct command from lines")
def distinct_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.dedupe(lines(spark, sf_dir))


PAIRS = f"""{LINES}, pairs as (
  select a.doc_id, a.pos, string_split(a.command, ' ') as a, string_split(b.command, ' ') as b
  from lines a join lines b on a.doc_id = b.doc_id and b.pos = a.pos + 1)"""


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    following = rows.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("command").alias("next"))
    return rows.join(following, ["doc_id", "pos"]).select(
        "doc_id", "pos", tokens_strict(F.col("command")).alias("a"), tokens_strict(F.col("next")).alias("b")
    )


@CATALOG.query(
    f"""with {PAIRS}, grams as (
      select doc_id, pos,
        case when len(a) >= 2 then list_transform(range(1, len(a)), lambda i: array_to_string(a[i:i + 1], ' ')) end as a,
        case when len(b) >= 2 then list_transform(range(1, len(b)), lambda i: array_to_string(b[i:i + 1], ' ')) end as b
      from pairs)
    select doc_id, pos, cast(len(a) + len(b) - 2 * len(list_distinct(list_intersect(a, b))) as bigint) as distance
    from grams"""
)
def bigram_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = ngram_distance(F.col("a"), F.col("b"), 2)
    return _line_pairs(spark, sf_dir).select("doc_id", "pos", distance.cast("bigint").alias("distance"))


@CATALOG.query(
    f"""with {PAIRS} select doc_id, pos,
      round((len(a) + len(b) - 2 * len(list_distinct(list_intersect(a, b)))) / (len(a) + len(b)), 6) as distance
    from pairs"""
)
def token_distance_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = token_distance(F.col("a"), F.col("b"))
    return rounded(_line_pairs(spark, sf_dir).select("doc_id", "pos", distance.alias("distance")), "distance")


def sql_overlap(query: str, reference: str, normalised: bool = True) -> str:
    """CTEs ending in ``nearest`` (id, numerator, denominator) between relations (id, t)."""
    denominator = "q.n + r.n" if normalised else "1"
    return f"""q as (select id, len(t) as n, list_distinct(t) as t from {query}),
    r as (select id, len(t) as n, list_distinct(t) as t from {reference}),
    qt as (select id, unnest(t) as token from q),
    rt as (select id, unnest(t) as token from r),
    overlap as (select qt.id as q, rt.id as r, count(*) as c from qt join rt using (token) group by all),
    gaps as (
      select q.id, q.n + r.n - 2 * coalesce(o.c, 0) as numerator, {denominator} as denominator
      from q cross join r left join overlap o on o.q = q.id and o.r = r.id),
    nearest as (
      select id, numerator, denominator from gaps
      qualify row_number() over (partition by id order by numerator / denominator, numerator) = 1)"""


@CATALOG.query(
    f"""with {LABELLED},
    abnormal as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 1),
    normal as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 0),
    {sql_overlap('abnormal', 'normal')}
    select id as cmd_id, round(numerator / denominator, 6) as distance from nearest"""
)
def nearest_token_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = sets.split_classes(labelled(spark, sf_dir))
    return rounded(nearest_distance(abnormal, normal).select("cmd_id", "distance"), "distance")


@CATALOG.query(
    f"""with {LABELLED},
    abnormal as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 1),
    normal as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 0),
    {sql_overlap('abnormal', 'normal')}
    select id as cmd_id, round(numerator / denominator, 6) as distance from nearest"""
)
def nearest_token_distance_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for query sides of any size: joined on token prefixes, nothing broadcast by hand."""
    normal, abnormal = sets.split_classes(labelled(spark, sf_dir))
    joined = nearest_distance(abnormal, normal, block_bytes=0)
    return rounded(joined.select("cmd_id", "distance"), "distance")


@CATALOG.query(
    f"""with {LABELLED},
    new as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 1),
    base as (select cmd_id as id, string_split(command, ' ') as t from labelled where label = 0),
    {sql_overlap('new', 'base', False)}
    select cmd_id, command from nearest join labelled on cmd_id = id where numerator > 4"""
)
def far_from_normals_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published distance of 4, joined on token prefixes."""
    normal, new = sets.split_classes(labelled(spark, sf_dir))
    return filter_by_distance(new, normal, block_bytes=0).select("cmd_id", "command")


@CATALOG.query(
    f"""with {COMMANDS},
    new as (select item_id as id, string_split(text, ' ') as t from benchmark),
    base as (select cmd_id as id, string_split(command, ' ') as t from commands where label = 0),
    {sql_overlap('new', 'base', False)}
    select id as cmd_id, text as command from nearest join benchmark on item_id = id where numerator > 30"""
)
def far_from_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cmd_id"), F.col("text").alias("command"))
    normal, _ = sets.split_classes(commands(spark, sf_dir))
    return filter_by_distance(new, normal, 30)


@CATALOG.query(
    f"""with {COMMANDS},
    known as (select distinct list_last(string_split(string_split(command, ' ')[1], '/')) as program
              from commands where label = 0)
    select conv_id, turn from conversations
    where list_last(string_split(string_split(text, ' ')[1], '/')) not in (select program from known)"""
)
def new_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("command"))
    normal, _ = sets.split_classes(commands(spark, sf_dir))
    return sets.filter_by_program(new, normal).select("conv_id", "turn")


@CATALOG.query(
    f"""with {LABELLED},
    heads as (select command as head, {sql_position('cmd_id', '0-normal')} as normal_no from labelled where label = 0
              qualify normal_no <= 100),
    tails as (select command as tail, {sql_position('cmd_id', '0-abnormal')} as abnormal_no from labelled where label = 1
              qualify abnormal_no <= 100)
    select normal_no, abnormal_no,
           md5(head || (['|', '||', '&&', ';'])[1 + {sql_hash("normal_no || '|' || abnormal_no")} % 4] || tail) as command,
           1 as label
    from heads cross join tails"""
)
def injected_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = sets.split_classes(labelled(spark, sf_dir))
    return inject(normal, abnormal, key="cmd_id").withColumn("command", F.md5("command"))


@CATALOG.query(
    """select text as command, 0 as label from documents union all select text, 1 from benchmark"""
)
def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = (
        table(spark, sf_dir, name).select(F.col("text").alias("command")) for name in ("documents", "benchmark")
    )
    return sets.label_union(normal, abnormal)


@CATALOG.query(
    f"""with {LABELLED} select command, label from labelled
    union all select unnest(['readlink', 'grep -w', 'top', 'jstat']), 0"""
)
def seeded_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.add_seed_rows(labelled(spark, sf_dir).select("command", "label"), DATASET_SEEDS)


SQL_PROGRAM = """list_last(string_split(
  case when t[1] like '%bash' or t[1] = 'sh' or t[1] like '%/sh'
       then list_filter(t[2:], lambda x: not starts_with(x, '-'))[1] else t[1] end, '/'))"""


@CATALOG.query(
    f"""with {PROCESS}
    select program, count(*) as n from (
      select {SQL_PROGRAM} as program from (select string_split(command, ' ') as t from process))
    where program is not null group by program"""
)
def program_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.program_histogram(process_commands(spark, sf_dir))


@CATALOG.query(
    f"""with {PROCESS}
    select count(distinct {SQL_PROGRAM}) as programs from (select string_split(command, ' ') as t from process)"""
)
def program_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.program_count(process_commands(spark, sf_dir))


@CATALOG.query(
    "select cast(len(string_split(text, ' ')) as bigint) as length, count(*) as n from documents group by 1"
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.length_histogram(commands(spark, sf_dir))


@CATALOG.query(
    f"""with {LINES}
    select (len(string_split(command, ' ')) // 5) * 5 || 's' as bucket, count(*) as n from lines group by 1"""
)
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.length_buckets(lines(spark, sf_dir))


@CATALOG.query(
    f"""with {COMMANDS},
    query as (select conv_id * 1000 + turn as id, turn % 2 as label, string_split(text, ' ') as t from conversations),
    base as (select cmd_id as id, string_split(command, ' ') as t from commands where label = 1),
    {sql_overlap('query', 'base')}
    select cast(label as integer) as label, round(numerator / denominator, 6) as distance, count(*) as n
    from nearest join query using (id) group by all"""
)
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("cmd_id"),
        (F.col("turn") % 2).cast("int").alias("label"),
        F.col("text").alias("command"),
    )
    _, abnormal = sets.split_classes(commands(spark, sf_dir))
    distances = rounded(nearest_distance(query, abnormal), "distance")
    return aggregates.distance_histogram(query.select("cmd_id", "label").join(distances, "cmd_id"))


@CATALOG.query(f"with {COMMANDS} select host, source, label, count(*) as n from commands group by all")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.class_counts(commands(spark, sf_dir), "host", "source", "label")


@CATALOG.query(
    f"""with {PROCESS}
    select count(*) as java_commands, count(distinct command) as distinct_java_commands
    from (select 'java ' || array_to_string(t[2:], ' ') as command
          from (select string_split(command, ' ') as t from process) where t[1] = 'java' or t[1] like '%/java')"""
)
def java_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.java_report(process_commands(spark, sf_dir))


@CATALOG.query(
    """select l_orderkey as id, l_returnflag as prediction from (
      select l_orderkey, l_returnflag, count(*) as votes, min(l_linenumber) as first_model
      from lineitem group by all)
    qualify row_number() over (partition by l_orderkey order by votes desc, first_model, l_returnflag) = 1"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("model"),
        F.col("l_returnflag").alias("prediction"),
    )
    return aggregates.majority_vote(answers)


@CATALOG.query(
    """select cast(l_linenumber as bigint) as train_size, round(avg(cast(l_discount as double)), 6) as mean_score,
              round(stddev_pop(cast(l_discount as double)), 6) as std_score
       from lineitem group by 1"""
)
def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("train_size"), F.col("l_discount").cast("double").alias("score")
    )
    return rounded(aggregates.curve_summary(scores), "mean_score", "std_score")
