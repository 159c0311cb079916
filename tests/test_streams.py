"""Streams scored against stored models: later runs read new files only, odd rows come through."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from auditlens.functions.text import nul_to_space, tokens_strict
from auditlens.operators.centroid import (
    centroid_distance,
    centroid_fit,
    centroid_terms,
    distance_of_terms,
    load_centroid,
    save_centroid,
)
from auditlens.operators.vocabulary import build_vocabulary, encode, gathered_ids, token_rows
from auditlens.streaming.audit import stream_audit
from auditlens.streaming.scoring import append_available

FIRST = [(1, "java -jar app"), (2, "java -jar tool"), (3, "")]
SECOND = [(4, "nc -l 99"), (5, "java " * 3000 + "end"), (6, None), (7, "java -jar app")]


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"cpid": str(i), "ccmdline": c}) for i, c in rows]
    (folder / name).write_text("\n".join(lines))


def texts(spark, folder):
    records = stream_audit(spark, str(folder), "h")
    return records.select(F.col("cpid").cast("long").alias("cmd_id"), nul_to_space(F.col("ccmdline")).alias("command"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "cmd_id long, command string")


def test_distances_of_two_arrivals(spark, tmp_path):
    folder, output, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    save_centroid(centroid_fit(batch(spark, FIRST)), str(tmp_path / "model"))
    model = load_centroid(spark, str(tmp_path / "model"))

    def run():
        terms = append_available(centroid_terms(texts(spark, folder), model), output, progress)
        return {r["cmd_id"]: round(r["distance"], 9) for r in distance_of_terms(terms, model).collect()}

    def expected(rows):
        return {r["cmd_id"]: round(r["distance"], 9) for r in centroid_distance(batch(spark, rows), model).collect()}

    arrive(folder, "a.log", FIRST)
    assert run() == expected(FIRST)
    assert run() == expected(FIRST)
    arrive(folder, "b.log", SECOND)
    assert run() == expected(FIRST + SECOND)


def test_codes_of_two_arrivals(spark, tmp_path):
    folder, output, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    known = build_vocabulary(batch(spark, FIRST))
    got = {}
    for name, rows in (("a.log", FIRST), ("b.log", SECOND)):
        arrive(folder, name, rows)
        coded = append_available(token_rows(texts(spark, folder), known, tokens_strict), output, progress)
        got = {r["cmd_id"]: r["ids"] for r in gathered_ids(coded).collect()}
    want = encode(batch(spark, FIRST + SECOND), known, tokens_strict)
    assert got == {r["cmd_id"]: r["ids"] for r in want.collect()}
    assert got[6] == [] and len(got[5]) == 3001


def test_an_empty_folder_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    known = build_vocabulary(batch(spark, FIRST))
    coded = append_available(
        token_rows(texts(spark, tmp_path / "in"), known, tokens_strict), str(tmp_path / "out"), str(tmp_path / "progress")
    )
    assert gathered_ids(coded).count() == 0
