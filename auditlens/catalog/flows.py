"""Cleaning flows from raw records and pages to labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import cleaning
from . import CATALOG
from .sampling import SQL_PATTERN
from .tables import COMMANDS, PROCESS, commands, process_commands, table
from .text import audit_records

@CATALOG.query(
    """select distinct md5(text || ' ') as command, cast(lang = 'es' as integer) as label,
              md5('0|' || text || ' ') as shuffle_key from documents"""
)
def built_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = audit_records(spark, sf_dir)
    normal, abnormal = records.where("cname <> 'es'"), records.where("cname = 'es'")
    return cleaning.build_dataset(normal, abnormal).withColumn("command", F.md5("command"))


ABNORMAL_PROCESS = "label = 1"


def _process_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = process_commands(spark, sf_dir)
    return rows, rows.where(ABNORMAL_PROCESS)


SQL_REMAINING = f"""{PROCESS},
    remaining as (select command from process except select command from process where {ABNORMAL_PROCESS}),
    named as (select command, {SQL_PATTERN} as pattern from remaining),
    capped as (
      select command from named where pattern is null
      union all
      select command from (
        select command from named where pattern is not null
        qualify row_number() over (partition by pattern order by md5('0|' || command), command) <= 500))"""


@CATALOG.query(f"with {SQL_REMAINING} select command from capped")
def cleaned_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_normals(*_process_classes(spark, sf_dir)).commands


@CATALOG.query(
    f"""with {SQL_REMAINING}
    select pattern, count(*) as n from named where pattern is not null group by pattern
    union all
    select 'java', count(*) from capped where string_split(command, ' ')[1] like '%/java'"""
)
def cleaning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_normals(*_process_classes(spark, sf_dir))
    java = cleaned.java_counts.select(F.lit("java").alias("pattern"), F.col("java_commands").alias("n"))
    return cleaned.pattern_counts.unionByName(java)


@CATALOG.query(
    """with listed as (
      select distinct trim(text) as command from (
        select text from benchmark union all select text from conversations) where trim(text) <> '')
    select command from listed
    union
    select 'sudo ' || command from listed where string_split(command, ' ')[1] <> 'sudo'"""
)
def additional_abnormals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [
        table(spark, sf_dir, name).select(F.col("text").alias("command")) for name in ("benchmark", "conversations")
    ]
    return cleaning.additional_abnormals(*lists)


NEW = """new as (
      select text as command from benchmark union all
      select 'sudo ' || text from benchmark where string_split(text, ' ')[1] <> 'sudo' union all
      select text from conversations union all
      select 'sudo ' || text from conversations where string_split(text, ' ')[1] <> 'sudo')"""


@CATALOG.query(
    f"""with {COMMANDS}, {NEW}
    select command, 0 as label, count(*) as n from commands where label = 0 group by command
    union all
    select command, 1, count(*) from (
      select command from commands where label = 1 union all
      select command from new where command not in (select command from commands where label = 0))
    group by command"""
)
def extended_abnormals(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = [
        table(spark, sf_dir, name).select(F.col("text").alias("command")) for name in ("benchmark", "conversations")
    ]
    extended = cleaning.extend_abnormals(commands(spark, sf_dir), new[0].unionByName(new[1]))
    return extended.groupBy("command", "label").agg(F.count("*").alias("n"))


@CATALOG.query(
    f"""with {COMMANDS}
    select md5(trim(command)) as command, label, count(*) as n from commands where command <> '' group by all
    union all
    select md5(s), 0, 1 from (select unnest(['readlink', 'grep -w', 'top', 'jstat']) as s)"""
)
def finalised_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = commands(spark, sf_dir).withColumn("command", F.concat(F.lit(" \t"), "command", F.lit("\n")))
    final = cleaning.finalise(padded)
    return final.groupBy(F.md5("command").alias("command"), "label").agg(F.count("*").alias("n"))


PLAIN = """replace(replace(replace(replace(replace(regexp_replace(regexp_extract(body, '(?s)<p\\b[^>]*>(.*?)</p>', 1),
  '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""


@CATALOG.query(
    f"""with blocks as (
      select page_id, unnest(range(len(l))) as block, unnest(l) as body from (
        select page_id, regexp_extract_all(regexp_extract(html, '(?s)^.*<h1\\b[^>]*>.*?</h1>(.*)$', 1),
                                           '(?s)<p\\b[^>]*>.*?</p>') as l from pages)),
    heads as (select page_id, block, string_split(trim({PLAIN}), chr(13) || chr(10))[1] as line from blocks),
    parts as (select page_id, block, list_filter(string_split_regex(trim(line), '[#$><]'), lambda x: x <> '') as p
              from heads where line <> '')
    select * from (
      select page_id, block, cast(0 as bigint) as line_no,
             nullif(case when len(p) = 2 and contains(p[1], '[') then trim(p[2])
                         when len(p) in (1, 2) then trim(p[1]) when len(p) = 3 then trim(p[2]) end, '') as command
      from parts) where command is not null"""
)
def page_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.pages_to_commands(
        table(spark, sf_dir, "pages"), "redirect", heading_tags=("h1",), block_tag="p"
    )


@CATALOG.query(
    f"""with {COMMANDS}
    select label, (len(string_split(command, ' ')) // 5) * 5 || 's' as bucket, count(*) as commands,
           cast(sum(length(command)) as bigint) as characters, count(*) filter (where length(command) > 1000) as over_1000
    from commands group by all"""
)
def command_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.profile_table(commands(spark, sf_dir))


@CATALOG.query(
    f"""with {COMMANDS}, tables as (
      select label, string_split(command, ' ') as t from commands)
    select case label when 0 then 'normal' else 'abnormal' end || '_programs' as name,
           list_last(string_split(t[1], '/')) as key, count(*) as n from tables group by all
    union all
    select case label when 0 then 'normal' else 'abnormal' end || '_buckets', (len(t) // 5) * 5 || 's', count(*)
    from tables group by all"""
)
def class_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = cleaning.profile(commands(spark, sf_dir))
    frames = [
        tables[f"{side}_{what}"].select(F.lit(f"{side}_{what}").alias("name"), F.col(column).alias("key"), "n")
        for side in ("normal", "abnormal")
        for what, column in (("programs", "program"), ("buckets", "bucket"))
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
