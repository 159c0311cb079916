"""Pipeline stages with users' columns of any name, and with texts that are not UTF-8."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.llm import exact_dedup, minhash, mixing, quality

from .conftest import words

NAMES = ["_id", "_key", "_digest", "_same", "_copy", "_copies", "_ID_"]


@pytest.fixture
def table(documents):
    base = words(1, 120).split()
    near = [*base]
    near[7] = "other"
    texts = [" ".join(base), " ".join(base), " ".join(near), words(2, 60), None, ""]
    frame = documents(texts)
    return frame.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def rows(df):
    return sorted(df.collect(), key=lambda r: r.doc_id)


@pytest.mark.parametrize("stage", [exact_dedup.drop_exact_copies, minhash.keep_one_of_each, mixing.take_mixed])
def test_stages_leave_all_columns_alone(table, stage):
    plain = table.drop(*NAMES)
    with_names, without = rows(stage(table)), rows(stage(plain))
    assert [r.doc_id for r in with_names] == [r.doc_id for r in without]
    for r in with_names:
        assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES]


def ranking():
    d = len(quality.FEATURES)
    return quality.Ranking(np.zeros(d), np.ones(d), np.ones(d), 0.0, 1.0)


def test_quality_filter_keeps_the_rows_that_score(table):
    kept = {r.doc_id for r in quality.keep_good(table, ranking()).collect()}
    scored = {r.id: r.score for r in quality.score_documents(table, ranking()).collect()}
    assert kept == {k for k, v in scored.items() if v >= 0.5}


def test_quality_filter_reads_invalid_utf8(spark, table):
    broken = table.withColumn("text", F.expr("cast(X'61FF6220C3' as string)"))
    scored = quality.score_documents(broken, ranking()).where("score >= 0.5").count()
    assert quality.keep_good(broken, ranking()).count() == scored
    assert quality.keep_good(broken.limit(0), ranking()).columns == broken.columns
