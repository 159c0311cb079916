"""Readers and writers on files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUL, nul_to_space
from ..session import scratch_path
from ..sources.audit import read_audit, source_size
from ..sources.commands import (
    read_command_list,
    read_labelled_csv,
    select_row_ranges,
    write_commands,
    write_labelled_csv,
)
from ..sources.datasets import assemble, load_or_build
from . import CATALOG
from .tables import COMMANDS, LINES, commands, lines, table
from .text import audit_records

AUDIT_SQL = """select cast(doc_id as varchar) as cpid, md5(text || ' ') as command,
    case when lang = 'en' then 'java' else lang end as pname, cast(n_chars as varchar) as ppid, 'agent1' as host
  from documents"""


def _audit_columns(df: DataFrame) -> DataFrame:
    return df.select("cpid", F.md5(nul_to_space(F.col("ccmdline"))).alias("command"), "pname", "ppid", "host")


@CATALOG.query(AUDIT_SQL)
def audit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    audit_records(spark, sf_dir).write.json(path)
    return _audit_columns(read_audit(spark, path, "agent1", patterns=("*.json", "*.log")))


@CATALOG.query(AUDIT_SQL)
def audit_scan_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "audit-gz")
    audit_records(spark, sf_dir).write.option("compression", "gzip").json(path)
    return _audit_columns(read_audit(spark, path, "agent1", patterns=("*.gz",), min_partitions=8))


@CATALOG.query(AUDIT_SQL + " where source not in ('src7', 'src3')")
def audit_directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "audit-tree")
    records = audit_records(spark, sf_dir).withColumn("folder", F.col("pcmdline"))
    records.write.partitionBy("folder").json(path)
    found = read_audit(
        spark, path, "agent1", patterns=("part-*",), exclude_dirs=("folder=src7", "folder=src3")
    )
    return _audit_columns(found)


@CATALOG.query(
    f"""with {LINES}
    select 'total' as file, round(sum(strlen(command) + 1) / 1048576, 2) as size_mb from lines"""
)
def source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sizes")
    lines(spark, sf_dir).select("command").write.text(path)
    return source_size(spark, path, patterns=("part-*",)).where("file = 'total'")


@CATALOG.query(
    f"""with {LINES}
    select command, label, 'agent1' as host, count(*) as n
    from lines where trim(command) <> '' group by all"""
)
def labelled_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    rows = lines(spark, sf_dir).select(F.replace("command", F.lit(" "), F.lit(NUL)).alias("command"), "label")
    write_labelled_csv(rows, path)
    return read_labelled_csv(spark, path, "agent1").groupBy("command", "label", "host").agg(
        F.count("*").alias("n")
    )


@CATALOG.query(
    f"""with {LINES}
    select trim(command) as command, count(*) as n from lines where trim(command) <> '' group by 1"""
)
def command_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "list")
    lines(spark, sf_dir).select(F.concat(F.lit("  "), "command", F.lit("\r")).alias("value")).write.text(path)
    return read_command_list(spark, path).groupBy("command").agg(F.count("*").alias("n"))


@CATALOG.query("select distinct text as command from documents where doc_id between 1 and 91 or doc_id >= 116")
def cheat_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_row_ranges(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOG.query(
    f"with {COMMANDS} select host, label, count(*) as n, min(cmd_id) as first_id from commands group by all"
)
def dataset_load_or_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dataset")
    build = lambda: commands(spark, sf_dir).drop("source")
    load_or_build(spark, path, build, ("host", "label"))
    stored = load_or_build(spark, path, build, ("host", "label"))
    return stored.groupBy("host", F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n"), F.min("cmd_id").alias("first_id")
    )


@CATALOG.query(
    f"""with {COMMANDS}
    select label, replace(command, chr(10), ' ') as command, count(*) as n from commands
    group by all"""
)
def command_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    rows = commands(spark, sf_dir)
    frames = []
    for label in (0, 1):
        write_commands(rows.where(F.col("label") == label), f"{path}/{label}")
        read = spark.read.text(f"{path}/{label}").groupBy(F.col("value").alias("command"))
        frames.append(read.agg(F.count("*").alias("n")).withColumn("label", F.lit(label)))
    return frames[0].unionByName(frames[1])


@CATALOG.query(
    f"""with {COMMANDS}
    select distinct command, 0 as label from commands where label = 0 and host = 'agent1'
    union all
    select command, 1 from (select command from commands where label = 1 union select text from benchmark)"""
)
def host_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commands(spark, sf_dir)
    known = table(spark, sf_dir, "benchmark").select(F.col("text").alias("command"))
    return assemble(rows.where("label = 0"), rows.where("label = 1"), known, host="agent1")
