from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

from auditlens.constants import DATASET_SEEDS
from auditlens.functions.text import tokens_alnum, tokens_strict
from auditlens.operators import aggregates, sampling, sets, vocabulary
from auditlens.operators.injection import inject
from auditlens.plans import cleaning
from auditlens.plans.sequences import prepare_sequences


def commands(df):
    return sorted(r["command"] for r in df.select("command").collect())


LABELLED = "command string, label int"


def test_conflicts(frame):
    df = frame([("a", 0), ("a", 0), ("b", 0), ("a", 1), ("c", 1)], LABELLED)
    assert sorted(map(tuple, sets.remove_conflicts(df, keep=1).collect())) == [("a", 1), ("b", 0), ("c", 1)]
    kept = sorted(map(tuple, sets.remove_conflicts(df, keep=0).collect()))
    assert kept == [("a", 0), ("a", 0), ("b", 0), ("c", 1)]


def test_strip_and_split(frame):
    df = frame([(" a ", 0), ("", 1), (None, 1), ("\tb\n", 1)], LABELLED)
    assert commands(sets.strip_commands(df)) == ["a", "b"]
    normal, abnormal = sets.split_classes(sets.non_empty(df))
    assert (normal.count(), abnormal.count()) == (1, 1)


def test_sudo_seeds_union(frame):
    df = frame([("ls",), ("sudo ls",), (" ",), ("sudoku x",)], "command string")
    assert commands(sets.augment_sudo(df)) == ["ls", "sudo ls", "sudo ls", "sudo sudoku x", "sudoku x"]
    both = sets.label_union(df.where("command = 'ls'"), df.where("command = ' '"))
    seeded = sets.add_seed_rows(both, DATASET_SEEDS)
    assert seeded.where("label = 0").count() == 5 and seeded.count() == 6


def test_filter_by_program(frame):
    new = frame([("/bin/ls -l",), ("rm x",), ("sh -c",)], "command string")
    base = frame([("ls",), ("cat",)], "command string")
    assert commands(sets.filter_by_program(new, base)) == ["rm x", "sh -c"]


def test_histograms(frame):
    df = frame([("/bin/ls -l",), ("ls",), ("sh",), ("bash a b c d e",)], "command string")
    got = {r["program"]: r["n"] for r in aggregates.program_histogram(df).collect()}
    assert got == {"ls": 2, "a": 1}
    assert aggregates.program_count(df).first()[0] == 2
    assert {r["bucket"]: r["n"] for r in aggregates.length_buckets(df).collect()} == {"0s": 3, "5s": 1}


def test_java_report(frame):
    df = frame([("/a/java x",), ("/b/java x",), ("java y",), ("ls",)], "command string")
    assert tuple(aggregates.java_report(df).first()) == (3, 2)
    assert tuple(aggregates.java_report(df.where("false")).first()) == (0, 0)


def test_majority_vote_ties(frame):
    rows = [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 1), (2, 2, 1), (3, 0, 0), (3, 1, 1)]
    got = dict(aggregates.majority_vote(frame(rows, "id long, model int, prediction int")).collect())
    assert got == {1: 1, 2: 1, 3: 0}


def test_cap_patterns(frame):
    rows = [f"grep -w {i}" for i in range(40)] + [f"readlink /proc/{i}/exe" for i in range(7)]
    rows += ["x grep -w 1", "/opt/j-k/jstat -gc 1", "plain"] + [f"/a/b/jstat -gc {i}" for i in range(12)]
    df = frame([(r,) for r in rows], "command string")
    kept = commands(sampling.cap_patterns(df, n=10))
    counts = collections.Counter(k.split(" ")[0].split("/")[-1] for k in kept if k not in ("x grep -w 1", "plain"))
    assert counts["grep"] == 10 and counts["readlink"] == 7
    assert sum(k.startswith("/a/b/jstat") for k in kept) == 10
    assert {"x grep -w 1", "/opt/j-k/jstat -gc 1", "plain"} <= set(kept)
    again = commands(sampling.cap_patterns(df.repartition(7), n=10, salts=3))
    assert kept == again


def test_positions_and_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    results = []
    for parts in (1, 9):
        ranked = sampling.hash_position(df.repartition(parts), "k").orderBy("position").collect()
        assert [r["position"] for r in ranked] == list(range(1, 1001))
        sample = sorted(r["k"] for r in sampling.sample_n(df.repartition(parts), 37, "k", 5).collect())
        assert len(sample) == 37
        results.append(([r["k"] for r in ranked], sample))
    assert results[0] == results[1]
    assert sampling.sample_n(df, 5000, "k").count() == 1000
    train, test = sampling.train_test_split(df, 0.2, "k")
    assert train.count() + test.count() == 1000 and 150 < test.count() < 250
    taken, skipped = sampling.take_skip(df, 300, "k")
    assert (taken.count(), skipped.count()) == (300, 700)


def test_range_position(spark):
    values = [random.Random(3).randrange(50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int").repartition(7)
    rows = sampling.range_position(df, ["v", "k"]).orderBy("position").collect()
    assert [(r["v"], r["k"]) for r in rows] == sorted((v, k) for k, v in enumerate(values))
    assert [r["position"] for r in rows] == list(range(1, 501))


def test_folds(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    sizes = collections.Counter(r["fold"] for r in sampling.k_fold(df, 5, "k").collect())
    assert sizes == {0: 5, 1: 5, 2: 5, 3: 4, 4: 4}
    contiguous = sampling.k_fold(df, 5, "k", shuffled=False).orderBy("k").collect()
    assert [r["fold"] for r in contiguous] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    few = collections.Counter(r["fold"] for r in sampling.k_fold(df.where("k < 3"), 5, "k").collect())
    assert few == {0: 1, 1: 1, 2: 1}
    splits = sampling.shuffle_split(df, 4, 0.3, "k")
    assert splits.groupBy("k").count().where("count = 4").count() == 23


def test_bagging(frame):
    normals = frame([(i, 0) for i in range(25)], "k int, label int")
    abnormals = frame([(100 + i, 1) for i in range(3)], "k int, label int")
    rows = sampling.bagging_chunks(normals, abnormals, "k", chunk=4, step=10).collect()
    by_model = collections.defaultdict(list)
    for r in rows:
        by_model[r["model"]].append((r["k"], r["label"]))
    assert set(by_model) == {0, 1}
    for members in by_model.values():
        assert sum(label == 0 for _, label in members) == 4 and sum(label for _, label in members) == 3
    assert sampling.bagging_chunks(normals, abnormals, "k", chunk=4, step=100).count() == 0


def test_vocabulary_and_encoding(frame):
    df = frame([(1, "a  b a"), (2, "c\td"), (3, ""), (4, "b")], "cmd_id long, command string")
    vocab = vocabulary.build_vocabulary(df)
    ids = dict(vocab.collect())
    assert set(ids) == {"a", "b", "c", "d"} and sorted(ids.values()) == [1, 2, 3, 4]
    encoded = {r["cmd_id"]: r["ids"] for r in vocabulary.encode(df, vocab, tokens_strict).collect()}
    assert encoded == {1: [ids["a"], -1, ids["b"], ids["a"]], 2: [-1], 3: [-1], 4: [ids["b"]]}
    extended = dict(vocabulary.build_vocabulary(frame([(9, "b z y")], "cmd_id long, command string"), base=vocab).collect())
    assert {k: v for k, v in extended.items() if k in ids} == ids
    assert {extended["z"], extended["y"]} == {5, 6}


def test_empty_text_encodes_to_empty_list(frame):
    df = frame([(1, "--"), (2, "x")], "cmd_id long, command string")
    vocab = vocabulary.build_vocabulary(df, tokens_alnum)
    encoded = {r["cmd_id"]: r["ids"] for r in vocabulary.encode(df, vocab, tokens_alnum).collect()}
    assert encoded == {1: [], 2: [1]}


def test_sequences(frame):
    rows = [(i, " ".join(["w"] * (i % 5 + 1)), i % 2) for i in range(20)]
    test, train = prepare_sequences(frame(rows, "cmd_id long, command string, label int"), take=6, size=4)
    assert (test.count(), train.count()) == (6, 14)
    batches = collections.defaultdict(set)
    for r in train.collect():
        batches[r["batch_id"]].add(len(r["ids"]))
        assert sum(i != 0 for i in r["ids"]) == r["cmd_id"] % 5 + 1
    assert len(batches) == 4 and all(len(lengths) == 1 for lengths in batches.values())


def test_injection(frame):
    normals = frame([(f"n{i}",) for i in range(30)], "command string")
    abnormals = frame([(f"x{i}",) for i in range(5)], "command string")
    rows = inject(normals, abnormals, n=10).collect()
    assert len(rows) == 50 and {r["label"] for r in rows} == {1}
    glue = {r["command"][r["command"].index("x") - 1] for r in rows}
    assert glue == {"|", "&", ";"}
    assert len({(r["normal_no"], r["abnormal_no"]) for r in rows}) == 50


def test_cleaning_flow(frame):
    normals = frame([(f"grep -w {i}",) for i in range(20)] + [("ls",), ("ls",), ("evil",), ("/x/java a",), ("/y/java a",)], "command string")
    abnormals = frame([("evil",)], "command string")
    cleaned = cleaning.clean_normals(normals, abnormals, n=5)
    assert len(commands(cleaned.commands)) == 8
    assert {r["pattern"]: r["n"] for r in cleaned.pattern_counts.collect()} == {"grep": 20}
    assert tuple(cleaned.java_counts.first()) == (2, 1)
    more = cleaning.additional_abnormals(frame([("rm",), (" rm ",)], "command string"), abnormals)
    assert commands(more) == ["evil", "rm", "sudo evil", "sudo rm"]
    labelled = sets.label_union(cleaned.commands, abnormals)
    extended = cleaning.extend_abnormals(labelled, frame([("ls",), ("rm",)], "command string"))
    assert commands(extended.where("label = 1")) == ["evil", "rm", "sudo ls", "sudo rm"]
    far = cleaning.extend_abnormals(labelled, frame([("ls",), ("a b c d e f",)], "command string"), min_distance=4)
    assert commands(far.where("label = 1")) == ["a b c d e f", "evil", "sudo a b c d e f"]
    programs = cleaning.extend_abnormals(labelled, frame([("/q/java z",), ("rm",)], "command string"), drop_known_programs=True)
    assert "/q/java z" not in commands(programs.where("label = 1"))
    final = cleaning.finalise(extended)
    assert final.where("label = 0").count() == 8 + 4
    tables = cleaning.profile(extended)
    assert tables["normal_programs"].where("program = 'grep'").first()["n"] == 5


def test_build_dataset(frame):
    normal = frame([("a\0b\0",), ("a\0b\0",), (None,)], "ccmdline string")
    abnormal = frame([("a\0b\0",), ("x",)], "ccmdline string")
    rows = cleaning.build_dataset(normal, abnormal).collect()
    assert sorted((r["command"], r["label"]) for r in rows) == [("a b ", 0), ("a b ", 1), ("x", 1)]


def test_pages_to_commands(spark):
    html = "<h3>t</h3><pre>x</pre><h3>实例</h3><pre>[root@h]# ls -l\n# note\n\npwd</pre>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r["command"] for r in cleaning.pages_to_commands(pages).orderBy("line_no").collect()] == ["ls -l", "pwd"]
    assert [r["command"] for r in cleaning.pages_to_commands(pages, "redirect").collect()] == ["ls -l"]


def test_long_commands(frame):
    df = frame([("x" * 1000,), ("x" * 1001,)], "command string")
    assert sets.long_commands(df).select(F.length("command")).first()[0] == 1001
