"""Records written for the streams are compressed, and read back as they were."""

from __future__ import annotations

import os

from auditlens.catalog.streams import _arrivals
from auditlens.functions.text import NUL
from auditlens.streaming.audit import AUDIT_SCHEMA


def test_arrivals_are_compressed(spark, frame, tmp_path):
    rows = frame([(1, "ls -l", 0), (2, "cat x", 1), (3, "", 0)], "cmd_id long, command string, label int")
    path = str(tmp_path / "arrivals")
    assert len(list(_arrivals(rows, path))) == 2
    parts = [f for _, _, files in os.walk(path) for f in files if f.startswith("part-")]
    assert parts and all(f.endswith(".json.gz") for f in parts)
    read = spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", True).json(path)
    got = {(r.cpid, r.ccmdline) for r in read.select("cpid", "ccmdline").collect()}
    assert got == {("1", f"ls{NUL}-l{NUL}"), ("2", f"cat{NUL}x{NUL}"), ("3", NUL)}
