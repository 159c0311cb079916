from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from auditlens.functions.lexical import lexical_columns
from auditlens.functions.text import nul_to_space
from auditlens.sources.audit import read_audit, source_size
from auditlens.sources.commands import (
    read_command_list,
    read_labelled_csv,
    select_row_ranges,
    write_commands,
    write_labelled_csv,
)
from auditlens.sources.datasets import assemble, dataset_exists, load_or_build
from auditlens.streaming.audit import stream_audit


def record(command, **more):
    return json.dumps({"ccmdline": command, "pname": "java", "extra": 1, **more})


def test_audit_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "a" / "x.log").write_text("\n".join([record("java\0-D\0"), "{broken", record(None)]))
    with gzip.open(tmp_path / "a" / "y.gz", "wt") as out:
        out.write(record("zipped"))
    (tmp_path / "a" / "other.txt").write_text(record("other"))
    (tmp_path / "skip" / "z.log").write_text(record("skipped"))
    found = read_audit(spark, str(tmp_path), "agent1", ("*.log", "*.gz"), exclude_dirs=("skip",))
    rows = {(r["ccmdline"], r["corrupt_record"], r["host"]) for r in found.collect()}
    assert rows == {
        ("java\0-D\0", None, "agent1"),
        (None, "{broken", "agent1"),
        (None, None, "agent1"),
        ("zipped", None, "agent1"),
    }
    names = {r["source_file"].rsplit("/", 1)[1] for r in found.select("source_file").collect()}
    assert names == {"x.log", "y.gz"}


def test_source_size(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 1048576)
    (tmp_path / "b.log").write_bytes(b"x" * 524288)
    got = {r["file"].rsplit("/", 1)[-1]: r["size_mb"] for r in source_size(spark, str(tmp_path)).collect()}
    assert got == {"a.log": 1.0, "b.log": 0.5, "total": 1.5}


def test_labelled_csv(spark, tmp_path, frame):
    rows = [("a, \"b\",c", 1), ("\0ls\0-l\0", 0), ("", 0), ("\0", 0), (" lead", 1), ("back\\slash", 0), ("two\nlines", 1)]
    write_labelled_csv(frame(rows, "command string, label int"), str(tmp_path / "out"))
    got = {(r["command"], r["label"], r["host"]) for r in read_labelled_csv(spark, str(tmp_path / "out"), "h").collect()}
    assert got == {
        ('a, "b",c', 1, "h"),
        ("ls -l", 0, "h"),
        (" lead", 1, "h"),
        ("back\\slash", 0, "h"),
        ("two lines", 1, "h"),
    }
    (tmp_path / "raw.csv").write_text("cmdline,label\nx,y,0\n\n \nls\0-a\0,1\n")
    (tmp_path / "header.csv").write_text("cmdline,label\n")
    got = read_labelled_csv(spark, [str(tmp_path / "raw.csv"), str(tmp_path / "header.csv")], "h")
    assert {(r["command"], r["label"]) for r in got.collect()} == {("x,y", 0), ("ls -a", 1)}


def test_command_list(spark, tmp_path, frame):
    (tmp_path / "l.txt").write_bytes(b"ls -l\r\r  pwd \r\r\r\ncat x\n \n")
    got = read_command_list(spark, str(tmp_path / "l.txt")).collect()
    assert sorted(r["command"] for r in got) == ["cat x", "ls -l", "pwd"]
    write_commands(frame([("a\nb",), ("c",)], "command string"), str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a b", "c"]


def test_row_ranges(frame):
    sheet = frame([(0, "h"), (1, "a"), (91, "b"), (92, "x"), (115, "y"), (116, "c"), (200, "a")], "pos int, v string")
    assert sorted(r["command"] for r in select_row_ranges(sheet, "pos", "v").collect()) == ["a", "b", "c"]


def test_load_or_build(spark, tmp_path, frame):
    path, calls = str(tmp_path / "set"), []

    def build():
        calls.append(1)
        return frame([("a", 0), ("b", 1)], "command string, label int")

    assert not dataset_exists(spark, path)
    for _ in range(2):
        assert load_or_build(spark, path, build, ("label",)).count() == 2
    assert len(calls) == 1 and dataset_exists(spark, path)


def test_assemble(frame):
    normals = frame([("a", "h1"), ("a", "h1"), ("b", "h2")], "command string, host string")
    bad = frame([("x",), ("y",)], "command string")
    more = frame([("y",), ("a",)], "command string")
    got = sorted((r["command"], r["label"]) for r in assemble(normals, bad, more, host="h1").collect())
    assert got == [("a", 0), ("a", 1), ("x", 1), ("y", 1)]


def test_stream_scores_like_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(record(f"java\0-D{i}\0") for i in range(5)))

    def score(df):
        plain = df.select(nul_to_space(F.col("ccmdline")).alias("c"))
        return plain.select("c", *lexical_columns(F.col("c")))

    query = (
        score(stream_audit(spark, str(folder), "h")).writeStream.format("memory").queryName("scored").start()
    )
    query.processAllAvailable()
    query.stop()
    batch = score(read_audit(spark, str(folder), "h"))
    assert sorted(spark.table("scored").collect()) == sorted(batch.collect())
    assert batch.count() == 5
