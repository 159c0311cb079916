"""Scoring of arriving records against stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_available(rows: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Append what has arrived since the last run to the Parquet table ``output``, stop, and return the table.

    ``rows`` is a stream without state: a scan, column functions, joins to stored models such as
    :func:`..operators.centroid.centroid_terms` and :func:`..operators.vocabulary.token_rows`. The checkpoint
    remembers which files were read and the table's log which batches are whole, so a run that was broken off is
    repeated without rows lost or doubled. Rows that need all terms of a text are summed up by the reader of the
    table, one aggregate without state to keep. Both folders must be reachable by all executors.
    """
    query = (
        rows.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(output)
