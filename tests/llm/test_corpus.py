"""Shards, mixes, URL verdicts, the queries and the pipeline."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlens.llm import bpe, exact_dedup, minhash, mixing, quality, queries, sharding, url_filter

from .conftest import words
from .test_dedup import brute_exact, brute_near

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


# Shards ---------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_copies(documents):
    texts = [words(i, 20 + i % 90) for i in range(1500)] + [words(3, 50)] * 10 + [words(4, 60)] * 400
    docs = documents(texts, clash=True, sources=["hot" if i % 3 else None for i in range(len(texts))])
    got = sharding.shard_documents(docs, n_shards=8).toPandas()
    assert sorted(got["id"]) == list(range(len(texts)))
    for r in got.itertuples():
        assert r.size == len(texts[r.id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.id].encode())
    sizes = got.groupby("shard")["size"].sum()
    assert list(sizes.index) == list(range(8))
    assert sizes.max() <= 1.06 * sizes.mean() and sizes.min() >= 0.94 * sizes.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got[got["id"].isin(range(1500, 1510))]["shard"].nunique() == 1
    again = sharding.shard_documents(docs.repartition(7), n_shards=8).toPandas()
    key = ["id", "shard", "slot"]
    assert got[key].sort_values("id").values.tolist() == again[key].sort_values("id").values.tolist()


def test_shard_edges(documents, mixed_texts):
    assert sharding.shard_documents(documents([]), n_shards=5).collect() == []
    got = sharding.shard_documents(documents(mixed_texts), n_shards=40).toPandas()
    assert len(got) == len(mixed_texts) and got["shard"].between(0, 39).all()
    assert got.set_index("id").loc[0, ["size", "text_crc32"]].tolist() == [16, 0]
    one = sharding.shard_documents(documents(mixed_texts), target_bytes=1 << 30).toPandas()
    assert set(one["shard"]) == {0}


def test_written_shards(spark, documents, tmp_path):
    docs = documents([words(i, 10) for i in range(50)])
    shards = sharding.shard_documents(docs, n_shards=4)
    sharding.write_shards(docs, shards, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


# Mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(documents):
    draw = np.random.default_rng(3)
    sources = [f"s{int(x)}" if x < 8 else None for x in draw.geometric(0.3, 600)]
    texts = [words(i, int(n)) if n else None for i, n in enumerate(draw.integers(0, 60, 600))]
    texts[5:300] = [texts[5]] * 295
    docs = documents(texts, clash=True, sources=sources)
    got = mixing.mix_sources(docs, per_salt=16).toPandas()
    assert sorted(got["id"]) == list(range(600))
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    got["taken"] = got["copies"] * got["size"]
    assert got["copies"].between(0, 3).all()
    for s, part in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert np.allclose(part["target"], targets[s]) and (part["source_size"] == sizes[s]).all()
        assert abs(part["taken"].sum() - targets[s]) <= part["size"].max()
    assert abs(got["taken"].sum() - sum(sizes.values())) <= 0.02 * sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(7), per_salt=16).toPandas()
    assert got.set_index("id")["copies"].sort_index().equals(again.set_index("id")["copies"].sort_index())


def test_mix_edges(documents):
    assert mixing.mix_sources(documents([])).collect() == []
    blank = mixing.mix_sources(documents([None, " ", ""])).collect()
    assert [(r.size, r.copies, r.target) for r in blank] == [(0, 0, 0.0)] * 3
    docs = documents(["a b", "a b", "c"], ids=[1, 1, 2], sources=["x", "x", "x"])
    assert sum(r.copies * r.size for r in mixing.mix_sources(docs).collect()) == 5


def test_newton_meets_small_and_capped_targets(spark):
    df = spark.createDataFrame([(1e6, 1.0), (10.0, 30.0), (7.0, 7.0), (0.0, 0.0), (5.0, 0.0)], "s double, t double")
    got = [r[0] for r in df.select(mixing.dual_rate(F.col("s"), F.col("t"), 3.0)).collect()]
    assert np.allclose(got, [1e-6, 3.0, 1.0, 0.0, 0.0], rtol=1e-8)


def test_null_and_repeated_ids_through_the_stages(documents):
    """Null ids, one row 50 times, and one id with two texts."""
    copy, other, single = words(1, 90), words(2, 80), words(3, 70)
    texts = [copy, copy, other] + [single] * 50 + [words(4, 60), words(5, 50)]
    ids = [1, 5, 5] + [7] * 50 + [None, None]
    docs = documents(texts, ids=ids, sources=["x"] * len(texts))
    expected = sorted(t for i, t in enumerate(texts) if i != 1)
    exact = exact_dedup.drop_exact_copies(docs)
    assert sorted(r.text for r in exact.collect()) == expected
    near = [copy.replace(copy.split()[40], "changed")] + texts[1:]
    assert sorted(r.text for r in minhash.keep_one_of_each(documents(near, ids=ids)).collect()) == sorted(
        near[:1] + near[2:]
    )
    for weights in ((1,), (1, 2)):
        sources = ["x", "y"] * (len(texts) // 2) + ["x"]
        frame = documents(texts, ids=ids, sources=sources)
        took = {}
        for r in mixing.take_mixed(frame, weights=weights).collect():
            took.setdefault(r.source, []).append(r.text)
        sizes = {s: sum(len(t.split()) for t, o in zip(texts, sources, strict=True) if o == s) for s in "xy"}
        for s, target in brute_targets(sizes, weights).items():
            assert abs(sum(len(t.split()) for t in took[s]) - target) <= 90
    assert sorted(r.text for r in mixing.take_mixed(docs).collect()) == sorted(texts)


def test_repeated_documents(documents):
    docs = documents(["a", "b", "c"])
    mix = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("copies"))
    got = mixing.repeat_documents(docs, mix)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 2]


# URLs -----------------------------------------------------------------------------------------------------------

URLS = [
    ("http://a.example.org/es/x?p=1#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("HTTP://EXAMPLE.ORG/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://org/", "org", "/", "org/", "allow"),
    ("https://borg/", "borg", "/", None, None),
    ("https://example.org", "example.org", "", None, None),
    ("https://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://x.com/deep", "x.com", "/deep", None, None),
    ("https://x.net?u=http://y.org/", "x.net", "", None, None),
    ("ftp://H.COM:80/fr/#a?b", "h.com:80", "/fr/", None, None),
    ("no scheme.org/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("x\ny://a.org/\n?q", "a.org", "/\n", "org/", "allow"),
]


def test_urls(spark):
    rows = [(i, u[0], "x", "y") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, label string").repartition(3)
    got = {r.id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(URLS * 3):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    good = [f"https://site{i}.example.com/news/{i}" for i in range(150)]
    bad = [f"http://x{i}{i * 7919}.spam.example.net/p/{i * 104729}?a={i}&b={i}&c=1" for i in range(150)]
    pages = spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")
    marks = spark.createDataFrame(
        [(u, 0) for u in good[:100]] + [(u, 1) for u in bad[:100]] + [(None, 1), ("x", None)], "url string, label int"
    )
    got = url_filter.judge_urls(pages, rules=(), labelled=marks).collect()
    right = [(r.verdict == "block") == (r.id >= 150) for r in got if r.id % 150 >= 100]
    assert np.mean(right) > 0.95


def test_suffixes_are_counted_beyond_the_training_sample(spark):
    urls = [(f"https://{words(i, 1)}.site{s}.org/{words(i, 2).replace(' ', '/')}", s % 2) for s in range(40) for i in range(30)]
    marks = spark.createDataFrame(urls, "url string, label int")
    pages = spark.createDataFrame([(s, f"https://new.site{s}.org/page") for s in range(40)], "page_id long, url string")
    got = url_filter.judge_urls(pages, rules=(), labelled=marks, train_rows=30).collect()
    assert [r.id % 2 for r in got] == [int(r.verdict == "block") for r in got]


def test_a_hot_url_does_not_fill_the_training_sample(spark):
    good = [f"https://a{i}.example.com/news/{i}" for i in range(50)]
    bad = [f"http://b{i}.example.com/p/{i * 104729}?a={i}&b={i}&c=1" for i in range(50)]
    frame = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, label int")
    first = frame.orderBy(F.xxhash64(F.lit(61), "url"), "url").first()
    marks = frame.unionByName(spark.createDataFrame([(first.url, first.label)] * 150, frame.schema))
    pages = spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")
    got = url_filter.judge_urls(pages, rules=(), labelled=marks, train_rows=100).collect()
    assert np.mean([(r.verdict == "block") == (r.id >= 50) for r in got]) > 0.95


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.org/")], "page_id long, url string")
    assert {r.id: r.verdict for r in url_filter.judge_urls(one).collect()} == {1: "allow", 2: "allow"}


# Queries and pipeline -------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_queries_run_over_whole_tables(spark):
    pages = {"op5_html_extraction", "op9_gbt_url_filter"}
    for name, query in queries.queries().items():
        table, key = ("embeddings", "vec_id") if name.startswith("op7") else ("documents", "doc_id")
        table, key = ("pages", "page_id") if name in pages else (table, key)
        table, key = ("conversations", "conv_id") if name.startswith("op11") else (table, key)
        if name.startswith("op12"):
            # Its rows are phrases: every language of the table is there, each ranked without gaps.
            langs = {r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("lang").collect()}
            ranks = {}
            for r in query(spark, SF_DIR).select("lang", "rank").collect():
                ranks.setdefault(r["lang"], []).append(r["rank"])
            assert set(ranks) <= {lang or "und" for lang in langs} and ranks, name
            assert all(sorted(r) == list(range(1, len(r) + 1)) for r in ranks.values()), name
            continue
        ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
        got = [r[0] for r in query(spark, SF_DIR).select(key).collect()]
        assert len(got) == len(ids) and set(got) == ids, name


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_near_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_near([(r.doc_id, r.text) for r in docs])
    got = queries.op2_minhash_dedup(spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_quality_query_on_held_out_labels(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = queries.op3_bradley_terry_quality(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([p == m for p, m in held]) > 0.9


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    ranking = queries.quality_ranking(spark, SF_DIR)
    frame = spark.createDataFrame(rows)
    scores = {r.id: r.score for r in quality.score_documents(frame, ranking).collect()}
    kept = {r.doc_id: r for r in rows if scores[r.doc_id] >= 0.5}
    exact = brute_exact([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if exact[i][0] == i}
    near = brute_near([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} <= set(kept)
    sizes = {}
    for r in kept.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    targets, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        taken[kept[r.doc_id].source] += len(kept[r.doc_id].text.split())
    largest = max(len(r.text.split()) for r in kept.values())
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    pairs = bpe.BytePairs(open(queries.public_tokenizers.path(queries.TOKENIZER), encoding="utf-8").read())
    for r in got[:50]:
        assert r.n_tokens == sum(len(pairs.ids(w)) for w in pairs.split_words(kept[r.doc_id].text))


def test_stages_handle_odd_tables(spark, documents, mixed_texts, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for texts in ([], mixed_texts):
        docs = documents(texts, clash=True)
        docs.write.parquet(str(tmp_path / f"d{len(texts)}" / "documents.parquet"))
        labels.write.parquet(str(tmp_path / f"d{len(texts)}" / "labels.parquet"))
        frame = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path / f"d{len(texts)}"))
            assert name == "bpe" or out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), out.schema)


def test_stages_keep_only_whole_rows(documents, mixed_texts):
    docs = documents(mixed_texts, clash=True)
    before = {tuple(r) for r in docs.collect()}
    for step in (exact_dedup.drop_exact_copies, minhash.keep_one_of_each):
        assert {tuple(r) for r in step(docs).collect()} <= before
