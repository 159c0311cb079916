"""Stored data sets: build once, load afterwards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ABNORMAL, NORMAL


def save_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write parquet; partition by ``host`` or ``label`` to let later reads skip folders."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def dataset_exists(spark: SparkSession, path: str) -> bool:
    """Whether a completed data set lies at ``path``, on any file system Spark can reach."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Load the data set at ``path``; without one, build and save it first."""
    if not dataset_exists(spark, path):
        save_dataset(build(), path, partition_by)
    return spark.read.parquet(path)


def assemble(normals: DataFrame, *abnormals: DataFrame, host: str | None = None) -> DataFrame:
    """``(command, label)``: the normals of one host and the union of the abnormal sources."""
    own = normals if host is None else normals.where(F.col("host") == host)
    bad = abnormals[0].select("command")
    for more in abnormals[1:]:
        bad = bad.unionByName(more.select("command"))
    return (
        own.select("command")
        .distinct()
        .select("command", F.lit(NORMAL).alias("label"))
        .unionByName(bad.distinct().select("command", F.lit(ABNORMAL).alias("label")))
    )
