"""Session settings, checkpoints and scratch folders."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "auditlens", **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a plain local session (one process, so one disk) without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="auditlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder.

    The part is removed when the driver's JVM ends in order; it holds nothing anyone else needs.
    """
    context = spark.sparkContext
    root = f"{shared_dir(spark).rstrip('/')}/auditlens-{context.applicationId}"
    if getattr(context, "_auditlens_scratch", None) != root:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._auditlens_scratch = root
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the copy.

    A lost executor then never forces a replay of what came before, readers prune columns, and the
    planner knows the size of the copy. ``codec``: a compression other than the session's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy._auditlens_path = path
    return copy


def discard(copy: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once nothing will read ``copy`` or what was made of it again."""
    context = copy.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(copy._auditlens_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """:func:`stored`, for jobs that iterate."""
    return stored(df, "lineage")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_auditlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # The archive stays: executors that start later fetch it too.
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="auditlens-"), "auditlens"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    context.addPyFile(archive)
    context._auditlens_shipped = True
