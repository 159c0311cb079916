"""The given tables in the shapes the operators expect, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import WHITESPACE_CLASS

WORD = r"[\p{L}\p{N}_]{2,}"
SPACE = WHITESPACE_CLASS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _host() -> Column:
    low = F.substring("source", 4, 10).cast("int") < 10
    return F.when(low, F.lit("agent1")).otherwise(F.lit("agent2"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a command; abnormal when marked toxic, normal otherwise."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        table(spark, sf_dir, "documents")
        .join(marks, "doc_id", "left")
        .select(
            F.col("doc_id").alias("cmd_id"),
            F.col("text").alias("command"),
            F.coalesce("toxic", F.lit(0)).cast("int").alias("label"),
            _host().alias("host"),
            "source",
        )
    )


COMMANDS = """commands as (
  select d.doc_id as cmd_id, d.text as command, cast(coalesce(l.toxic, 0) as integer) as label,
         case when cast(substr(d.source, 4) as integer) < 10 then 'agent1' else 'agent2' end as host,
         d.source
  from documents d left join labels l using (doc_id))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that carry a mark."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return (
        table(spark, sf_dir, "documents")
        .join(marks, "doc_id")
        .select(F.col("doc_id").alias("cmd_id"), F.col("text").alias("command"), "label")
    )


LABELLED = """labelled as (
  select d.doc_id as cmd_id, d.text as command, cast(l.toxic as integer) as label
  from documents d join labels l using (doc_id))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a command, with the label of its document."""
    return commands(spark, sf_dir).select(
        F.col("cmd_id").alias("doc_id"), "label", F.posexplode(F.split("command", "\n")).alias("pos", "command")
    ).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "command", "label")


LINES = """lines as (
  select doc_id, label, unnest(range(len(p))) as pos, unnest(p) as command
  from (select d.doc_id, cast(coalesce(l.toxic, 0) as integer) as label, string_split(d.text, chr(10)) as p
        from documents d left join labels l using (doc_id)))"""


def process_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell commands written from line items: six kinds, mostly repetitive, some abnormal."""
    c = F.col
    kind = c("l_linenumber")
    command = (
        F.when(kind == 1, F.concat(F.lit("grep -w "), c("l_orderkey")))
        .when(kind == 2, F.concat(F.lit("readlink /proc/"), c("l_partkey"), F.lit("/exe")))
        .when(kind == 3, F.concat(F.lit("top -p "), c("l_suppkey"), F.lit(" -bn 1")))
        .when(kind == 4, F.concat(F.lit("/opt/jdk/bin/jstat -gc "), c("l_orderkey")))
        .when(kind == 5, F.concat(F.lit("cp -rf /opt/webserver/"), c("l_partkey"), F.lit(" /tmp")))
        .when(kind == 6, F.concat(F.lit("/usr/java"), c("l_suppkey"), F.lit("/bin/java -Dapp="), c("l_partkey")))
        .otherwise(F.concat(F.lit("/bin/bash -x -e /srv/"), c("l_suppkey"), F.lit(".sh "), c("l_partkey")))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", kind.alias("l_linenumber"), command.alias("command"),
        F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


PROCESS = """process as (
  select l_orderkey, l_linenumber,
         case l_linenumber
           when 1 then 'grep -w ' || l_orderkey
           when 2 then 'readlink /proc/' || l_partkey || '/exe'
           when 3 then 'top -p ' || l_suppkey || ' -bn 1'
           when 4 then '/opt/jdk/bin/jstat -gc ' || l_orderkey
           when 5 then 'cp -rf /opt/webserver/' || l_partkey || ' /tmp'
           when 6 then '/usr/java' || l_suppkey || '/bin/java -Dapp=' || l_partkey
           else '/bin/bash -x -e /srv/' || l_suppkey || '.sh ' || l_partkey end as command,
         case when l_returnflag = 'R' then 1 else 0 end as label
  from lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dense rows; label 0 is the abnormal class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
    )


VECTORS = """vectors as (
  select vec_id as id, cast(embedding as double[]) as features,
         case when label = 0 then 1 else 0 end as label
  from embeddings)"""


def digest(tokens: Column) -> Column:
    """One value that pins a whole token list."""
    return F.md5(F.array_join(tokens, "\u0001"))


def sql_digest(tokens: str) -> str:
    return f"md5(array_to_string({tokens}, chr(1)))"


def sql_hash(key: str, seed: int | str = 0) -> str:
    """SQL of the 32-bit hash behind splits and picks."""
    return f"cast('0x' || substring(md5('{seed}|' || {key}), 1, 8) as bigint)"


def sql_position(key: str, seed: int | str = 0) -> str:
    return f"row_number() over (order by md5('{seed}|' || {key}), {key})"


def sql_entropy(text: str) -> str:
    counts = "list_transform(list_distinct(s), lambda c: len(list_filter(s, lambda x: x = c)))"
    return f"""(select case when len(s) = 0 then 0.0 else round(coalesce(
        list_sum(list_transform({counts}, lambda n: -(n / len(s)) * log2(n / len(s)))), 0.0), 7) end
      from (select regexp_extract_all({text}, '(?s).') as s))"""


def sql_report(relation: str) -> str:
    """CTEs ending in ``report`` for a relation with label and prediction."""
    return f"""classes as (
  select distinct unnest([label, prediction]) as class from {relation}),
measures as (
  select class,
         count(*) filter (where label = class and prediction = class) as tp,
         count(*) filter (where prediction = class) as predicted,
         count(*) filter (where label = class) as support
  from classes, {relation} group by class),
scored as (
  select class, support, tp,
         case when predicted = 0 then 0.0 else tp / predicted end as "precision",
         case when support = 0 then 0.0 else tp / support end as recall
  from measures),
with_f1 as (
  select *, case when "precision" + recall = 0 then 0.0
                 else 2 * "precision" * recall / ("precision" + recall) end as f1 from scored),
report as (
  select cast(class as varchar) as class, "precision", recall, f1, support from with_f1
  union all select 'accuracy', null, null, sum(tp) / sum(support), cast(sum(support) as bigint) from with_f1
  union all select 'macro avg', avg("precision"), avg(recall), avg(f1), cast(sum(support) as bigint) from with_f1
  union all select 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), cast(sum(support) as bigint) from with_f1)"""


REPORT_COLUMNS = """class, round("precision", 6) as "precision", round(recall, 6) as recall,
  round(f1, 6) as f1, support"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round once, at the very end; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def report_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, "precision", "recall", "f1")


def sql_tfidf(fit: str, rows: str | None = None) -> str:
    """CTEs ending in ``tfidf`` (cmd_id, label, term, weight) of ``rows`` under a model on ``fit``."""
    rows = rows or fit
    return f"""fit_terms as (
  select distinct cmd_id, unnest(regexp_extract_all(lower(command), '{WORD}')) as term from {fit}),
idf as (
  select term, count(*) as df, ln((1.0 + (select count(*) from {fit})) / (1 + count(*))) + 1 as idf
  from fit_terms group by term),
row_terms as (
  select cmd_id, label, term, count(*) as tf
  from (select cmd_id, label, unnest(regexp_extract_all(lower(command), '{WORD}')) as term from {rows})
  group by cmd_id, label, term),
raw as (select cmd_id, label, term, tf * idf as x from row_terms join idf using (term)),
norms as (select cmd_id, sqrt(sum(x * x)) as norm from raw group by cmd_id),
tfidf as (select cmd_id, label, term, x / norm as weight from raw join norms using (cmd_id))"""
