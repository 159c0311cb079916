"""A key, a token or a group of copies that holds a third of the rows."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from auditlens.functions.text import tokens_strict
from auditlens.operators import sampling, sets, tfidf, vocabulary

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@contextlib.contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """A third of the rows are one command, and every row holds the token ``hot``."""
    n = 12_000
    command = F.when(F.col("id") % 3 == 0, "hot same words here").otherwise(
        F.concat(F.lit("hot a"), F.col("id"), F.lit(" b"), F.col("id") % 997)
    )
    return spark.range(0, n, 1, 6).select(
        F.col("id").alias("cmd_id"), command.alias("command"), (F.col("id") % 2).cast("int").alias("label")
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_lookup_splits_the_hot_term(spark, hot):
    with settings(spark, SMALL):
        model = tfidf.tfidf_fit(hot)
        weights = tfidf.tfidf_transform(hot, model)
        assert "skew=true" in final_plan(weights)
        assert weights.count() == 4000 * 4 + 8000 * 3


def test_encoding_splits_the_hot_token(spark, hot):
    with settings(spark, SMALL):
        encoded = vocabulary.encode(hot, vocabulary.build_vocabulary(hot), tokens_strict)
        assert "skew=true" in final_plan(encoded)
        assert encoded.agg(F.sum(F.size("ids"))).first()[0] == 4000 * 4 + 8000 * 3


def test_anti_join_splits_the_hot_command(spark, hot):
    # Copies shrink when compressed, and skew is measured in compressed bytes.
    tiny = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    with settings(spark, {**SMALL, **tiny}):
        known = hot.where("cmd_id % 3 = 1").select("command")
        left = sets.not_in(hot, known, "command")
        assert "skew=true" in final_plan(left)
        assert left.count() == 8000


def test_copies_collapse_where_they_are_read(spark, hot):
    """Distinct counts of copies: each task sends one row per command, not its copies."""
    plan = sets.dedupe(hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_cap_ranks_a_hot_pattern_before_the_shuffle(spark, hot):
    capped = sampling.cap_patterns(hot, (("hot", "^hot a"),), n=100)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert capped.where("command like 'hot a%'").count() == 100
    assert capped.where("command not like 'hot a%'").count() == 4000


def test_outlier_joins_split_a_hot_neighbour(spark):
    """All copies share their neighbours: those points are looked up by a third of the rows."""
    import numpy as np

    from auditlens.operators import neighbours

    rng = np.random.default_rng(0)
    points = rng.normal(size=(1500, 3))
    points[:500] = points[0]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
    tiny = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    with settings(spark, {**SMALL, **tiny}):
        scored = neighbours.local_outlier_factor(df.repartition(6), 20)
        assert "skew=true" in final_plan(scored)
        lof = {r["id"]: r["lof"] for r in scored.collect()}
    assert len(lof) == 1500 and all(abs(lof[i] - 1) < 1e-6 for i in range(500))
