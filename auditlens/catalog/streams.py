"""Streams over records that Spark writes from the tables, scored against stored models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUL, nul_to_space, tokens_strict, tokens_ws
from ..operators import vocabulary
from ..operators.centroid import centroid_fit, centroid_terms, distance_of_terms, load_centroid, save_centroid
from ..operators.sets import split_classes
from ..session import scratch_path
from ..streaming.audit import stream_audit
from ..streaming.scoring import append_available
from . import CATALOG
from .evaluation import SQL_CENTROID
from .sampling import sql_vocabulary
from .tables import COMMANDS, commands, labelled, rounded


def _arrivals(rows: DataFrame, path: str) -> Iterator[None]:
    """Write ``rows`` as compressed audit records below ``path``: normals first, abnormals after the caller went on."""
    command = F.concat(F.replace("command", F.lit(" "), F.lit(NUL)), F.lit(NUL))
    records = rows.select("label", F.col("cmd_id").cast("string").alias("cpid"), command.alias("ccmdline"))
    for label, name in ((0, "first"), (1, "second")):
        records.where(F.col("label") == label).drop("label").write.json(f"{path}/{name}", compression="gzip")
        yield


def _streamed(
    spark: SparkSession, rows: DataFrame, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The table that two runs of one stream append to, one run after each arrival of files."""
    path, output, checkpoint = (scratch_path(spark, name) for name in ("arrivals", "appended", "progress"))
    table = None
    for _ in _arrivals(rows, path):
        records = stream_audit(spark, path, "agent1", "part-*")
        texts = records.select(
            F.col("cpid").cast("bigint").alias("cmd_id"), nul_to_space(F.col("ccmdline")).alias("command")
        )
        table = append_available(score(texts), output, checkpoint)
    return table


@CATALOG.query(f"with {SQL_CENTROID} select cmd_id, round(distance, 6) as distance from distances")
def streamed_centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of streamed records to a stored centroid equal those of the batch."""
    rows = labelled(spark, sf_dir)
    path = scratch_path(spark, "centroid")
    save_centroid(centroid_fit(rows.where("label = 0")), path)
    model = load_centroid(spark, path)
    terms = _streamed(spark, rows, lambda texts: centroid_terms(texts, model))
    return rounded(distance_of_terms(terms, model), "distance")


@CATALOG.query(
    f"""with {COMMANDS}, vocabulary as ({sql_vocabulary('(select * from commands where label = 0)')}),
    occurrences as (select cmd_id, unnest(range(len(t))) as pos, unnest(t) as token
                    from (select cmd_id, string_split(command || ' ', ' ') as t from commands))
    select cmd_id, count(*) as tokens, count(*) filter (where token_id is null) as unknown,
           md5(string_agg(cast(coalesce(token_id, -1) as varchar), ',' order by pos)) as digest
    from occurrences left join vocabulary using (token) group by cmd_id"""
)
def streamed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed records as ids of a stored vocabulary; a record ends with a separator, so with one token more."""
    rows = commands(spark, sf_dir)
    normal, _ = split_classes(rows)
    path = scratch_path(spark, "vocabulary")
    vocabulary.build_vocabulary(normal, tokens_ws).write.parquet(path)
    known = spark.read.parquet(path)
    coded = _streamed(spark, rows, lambda texts: vocabulary.token_rows(texts, known, tokens_strict))
    ids = vocabulary.gathered_ids(coded)
    return ids.select(
        "cmd_id",
        F.size("ids").cast("bigint").alias("tokens"),
        F.size(F.filter("ids", lambda i: i == -1)).cast("bigint").alias("unknown"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"),
    )
