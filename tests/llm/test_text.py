"""Encoding, scoring, quality and page text."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlens import session
from auditlens.llm import bpe, html_extract, ppm, quality
from auditlens.llm.words import WordIds, shingles, word_ids

from .conftest import words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs(open(PATH, encoding="utf-8").read())


ODD = [
    "", " ", "It's we'll THEY'RE 'sometimes' 123 4.5", "<|endoftext|>x<|startoftext|> a<|endoftext|", "ΣΑΣ Σ İstanbul",
    "é café  x y z", "a\x1cb\x1fc\x85d\x0be", "日本語テキスト 한국어 العربية", "👩‍👩‍👧 ok 🇩🇪",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000 + "!" * 500,
    "́́ ́", "ﬁ ½ ² ①", "a_b-c/d\\e@f#g", "\x00\x01 nul", "ß ẞ ŉ", "ʼn 's 'S", "﻿ bom �",
]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text, pairs, library):
    ids = [i for w in pairs.split_words(text) for i in pairs.ids(w)]
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids == expected
    assert pairs.decoded(ids) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=40))
def test_ids_equal_the_library_on_any_latin_text(text):
    pairs, library = _both()
    ids = [i for w in pairs.split_words(text) for i in pairs.ids(w)]
    assert ids == library.encode(text, add_special_tokens=False).ids


_CACHE = []


def _both():
    if not _CACHE:
        _CACHE.append((bpe.BytePairs(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)))
    return _CACHE[0]


def test_cuts_are_certain(pairs):
    """Pieces encoded by themselves give what the whole word gives."""
    cut = 0
    for n in range(60):
        for token in words(n, 8).split() + ["qzxjkvwq", "züñqx"]:
            shown = [pairs.symbols[b] for b in token.encode()]
            shown[-1] += pairs.suffix
            cut += any(p not in pairs.inside for p in zip(shown, shown[1:]))
            assert pairs.token_ids(token) == pairs.merged(tuple(shown))
    assert cut


def test_encode_decode_and_digests(documents, mixed_texts, library):
    docs = documents(mixed_texts + ODD, clash=True)
    ids = {r.id: r.ids for r in bpe.encode_texts(docs, PATH).collect()}
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in mixed_texts + ODD]
    assert ids == dict(enumerate(expected))
    texts = {r.id: r.text for r in bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()}
    assert texts == {i: library.decode(e, skip_special_tokens=False) for i, e in enumerate(expected)}
    encoded = bpe.encode_texts(docs, PATH).select(
        "id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("d")
    )
    digests = {r.id: (r.n_tokens, r.ids_sha256) for r in bpe.token_digests(docs, PATH).collect()}
    assert {r.id: (len(ids[r.id]), r.d) for r in encoded.collect()} == digests
    assert bpe.token_digests(documents([]), PATH).collect() == []


# Language model -------------------------------------------------------------------------------------------------


class BrutePpm:
    """Symbol by symbol, with dictionaries."""

    def __init__(self, trained, deep):
        self.deep, self.tables = deep, [{} for _ in range(deep + 1)]
        for t in trained:
            symbols = self._padded(t)
            for k in range(deep, len(symbols)):
                for order in range(deep, -1, -1):
                    seen = self.tables[order].setdefault(tuple(symbols[k - order : k]), Counter())
                    seen[symbols[k]] += 1
                    if order and seen[symbols[k]] > 1:  # a shorter context counts what is new to the longer one
                        break
        self.kept = []
        for table in self.tables:
            n = Counter(n for seen in table.values() for n in seen.values())
            self.kept.append(min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.95) if n[1] + n[2] else 0.5)

    def _padded(self, text):
        return [ppm.END] * self.deep + list(text) + [ppm.END]

    def distribution(self, context):
        """Probability of every symbol after as many symbols as the trie is deep."""
        found, reach = {}, 1.0
        for order in range(self.deep, -1, -1):
            whole = self.tables[order].get(tuple(context[self.deep - order :]), {})
            counts = {s: n for s, n in whole.items() if s not in found}
            if not counts:
                continue
            kept, total = self.kept[order] if len(whole) < ppm.SYMBOLS else 0.0, sum(counts.values())
            found |= {s: reach * (n - kept) / total for s, n in counts.items()}
            reach *= kept * len(counts) / total
        rest = [s for s in range(ppm.SYMBOLS) if s not in found]
        return found | {s: reach / len(rest) for s in rest}

    def score(self, text):
        symbols = self._padded(text)
        held = {}
        total = 0.0
        for k in range(self.deep, len(symbols)):
            context = tuple(symbols[k - self.deep : k])
            if context not in held:
                held[context] = self.distribution(context)
            total += math.log10(held[context][symbols[k]])
        return total


@pytest.mark.parametrize("order", [1, 2, 4])
def test_probabilities_of_a_context_sum_to_one(spark, order):
    trained = [b"banana band", b"abracadabra", b"\xff\x00 an", b"", bytes(range(256)) * 3]
    model = BrutePpm(trained, order)
    seen = [int(c) for t in trained for c in ppm._cells(t, order)]
    contexts = sorted({c // ppm.SYMBOLS for c in seen})[:20]
    asked = [(c * ppm.SYMBOLS + s, 0) for c in contexts for s in range(ppm.SYMBOLS)]
    cells = spark.createDataFrame([(c, 1) for c in seen] + asked, "cell long, n long")
    found = {r.cell: r.p for r in ppm.cell_probabilities(ppm.trie_levels(cells, order)).collect()}
    for c in contexts:
        own = [found[c * ppm.SYMBOLS + s] for s in range(ppm.SYMBOLS)]
        digits = [c // ppm.SYMBOLS**i % ppm.SYMBOLS for i in range(order)][::-1]
        assert math.isclose(sum(own), 1, rel_tol=1e-9)
        assert np.allclose(own, [model.distribution(digits)[s] for s in range(ppm.SYMBOLS)], rtol=1e-9)


@pytest.mark.parametrize("block_bytes", [2_000, 8 << 20])
def test_scores(documents, mixed_texts, block_bytes):
    texts = mixed_texts + [words(i, 40) for i in range(30)] + [words(3, 40)] * 3
    texts += ["".join(chr(c) for c in range(1, 128)) * 2, "\x07\x07 zz \x07", "q\U0001f600q", "abab" * 20]
    docs = documents(texts, clash=True)
    held = ppm.held_out_rows(F.col("doc_id"))
    got = {r.id: r for r in ppm.score_documents(docs, held, block_bytes=block_bytes).collect()}
    tokens = [(t or "").encode().lower().split() + [b" "] for t in texts]
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in t)
    n, v = sum(counts.values()), len(counts)
    model = BrutePpm([(t or "").encode() for t, o in zip(texts, out, strict=True) if not o], ppm.ORDER)
    assert len(got) == len(texts)
    for i, found in enumerate(tokens):
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found)
        assert (r.held_out, r.n_tokens, r.n_known) == (out[i], len(found), sum(w in counts for w in found))
        assert r.train_tokens == n and math.isclose(r.base_score, base, rel_tol=1e-9)
        if len(texts[i] or "") < 5000:
            assert math.isclose(r.score, model.score((texts[i] or "").encode()), rel_tol=1e-9), i


def test_ppm_cells_of_many_chunks_merge(monkeypatch):
    monkeypatch.setattr(ppm, "_CHUNK", 50)
    texts = [bytes(random.Random(i).choices(b"ab", k=30)) for i in range(40)]
    cells, counts = ppm._distinct(texts, 5)
    want = Counter(int(c) for t in texts for c in ppm._cells(t, 5))
    assert dict(zip(cells.tolist(), counts.tolist(), strict=True)) == want and (np.diff(cells) > 0).all()
    empty = np.empty(0, np.int64)
    assert [x.tolist() for x in ppm._merged(cells[:3], counts[:3], empty, empty)] == [cells[:3].tolist(), counts[:3].tolist()]


def test_ppm_stores_its_cells_in_the_smaller_coding(spark, documents, monkeypatch):
    written = {}

    def spy(df, name="rows", codec=None):
        written[name] = (copy := session.stored(df, name, codec)).inputFiles()
        return copy

    monkeypatch.setattr(ppm, "stored", spy)
    ppm.score_documents(documents(["some text"] * 20), ppm.held_out_rows(F.col("doc_id"))).collect()
    assert all(f.endswith(".zstd.parquet") for name, files in written.items() if name != "words" for f in files)
    assert {"asked", "level-0", f"level-{ppm.ORDER}"} < set(written)


def test_scores_of_empty_and_untrained_tables(documents):
    held = ppm.held_out_rows(F.col("doc_id"))
    assert ppm.score_documents(documents([]), held).collect() == []
    row = ppm.score_documents(documents(["ab"]), F.lit(True)).collect()[0]
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 2)
    assert math.isclose(row.score, -3 * math.log10(ppm.SYMBOLS), rel_tol=1e-9) and row.base_score == 0


# Quality --------------------------------------------------------------------------------------------------------


def quality_corpus():
    good = [words(i, 30 + i) + ". " + words(1000 + i, 20).capitalize() for i in range(60)]
    kinds = [lambda i: "spam " * 40, lambda i: words(i, 40).upper(), lambda i: words(i, 40).replace(" ", "*** ")]
    bad = [kinds[i // 3 % 3](i) for i in range(40)]
    return good, bad


def test_quality_separates_and_generalises(spark, documents):
    good, bad = quality_corpus()
    docs = documents(good + bad, clash=True)
    marks = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(100) if i % 3] + [(None, 1), (500, 0), (1, None)], "id long, label int"
    )
    ranking = quality.fit_ranking(*quality.training_rows(docs, marks))
    scores = {r.id: r.score for r in quality.score_documents(docs, ranking).collect()}
    assert len(scores) == 100 and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.5) == (i < 60) for i in range(0, 100, 3)]) > 0.95
    kept = quality.keep_good(docs, ranking)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.5}


def test_quality_edges(spark, documents, mixed_texts):
    none = spark.createDataFrame([], "id long, label int")
    docs = documents(mixed_texts)
    ranking = quality.fit_ranking(*quality.training_rows(docs, none))
    got = quality.score_documents(docs, ranking).collect()
    assert len(got) == len(mixed_texts) and {r.score for r in got} == {0.5}
    assert quality.score_documents(documents([]), ranking).collect() == []
    repeated = documents(mixed_texts + mixed_texts, ids=[*range(len(mixed_texts))] * 2)
    assert quality.score_documents(repeated, ranking).count() == 2 * len(mixed_texts)


def test_training_sample_is_bounded(spark, documents):
    good, bad = quality_corpus()
    marks = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "id long, label int")
    rows, labels = quality.training_rows(documents(good + bad), marks, rows=30)
    assert len(rows) == len(labels) == 30


def test_repeated_ids_train_once(spark, documents):
    docs = documents(["a b c"] * 100 + ["A! B!", "d e"], ids=[1] * 100 + [2, 3])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, label int")
    x, y = quality.training_rows(docs, labels, rows=3)
    assert x.shape == (3, len(quality.FEATURES)) and sorted(y) == [0, 1, 1]


def test_shingles():
    ids = WordIds()
    assert len(shingles(word_ids(None, ids))) == 0
    assert len(shingles(word_ids(b"a b", ids))) == 1
    assert len(shingles(word_ids(b"a b c d e f a b c d e", ids))) == 6
    assert (shingles(word_ids(b"A B\tc", ids)) == shingles(word_ids(b"a  b\nC", ids))).all()
    assert shingles(word_ids(b"a b", ids))[0] != shingles(word_ids(b"a b c", ids))[0]


# Pages ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a><li>More</ul></nav><!-- ad <p>no -->
<div class="ad">Buy now, it is a very good thing to buy, really.</div><div id='cookie-notice'>We use cookies.</div>
<article><header><h2>Title &amp; more</h2><span>by someone</span></header><p><b>First   line
goes &lt;on&gt;<br>here.<p>Second &eacute; &#x41; <i>bold</i>ed<ul><li>one<li>two</ul><form><p>mail</p></form>
<table><tr><td>cell<td>next</table><section class="comments"><p>First! A long comment by a reader, as they are.</p></section>
</article><aside>Side</aside><footer>&copy; All rights reserved, every one of them.</footer></body></html>"""


def test_article():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Title & more", "First line goes <on> here.", "Second é A bolded", "one", "two", "cell", "next",
    ]


def test_ratios_without_an_article():
    body = "".join(f"<p>{words(i, 40)}, {words(i + 90, 20)}. {words(i + 50, 30)}.</p>" for i in range(5))
    page = f"<body><div><a>home</a> <a>news</a> <a>mail</a></div><div><div>{body}</div></div><div><a>x</a><a>y</a></div></body>"
    text = html_extract.main_text(page)
    assert text.count("\n") == 4 and "news" not in text and words(4, 40) in text


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain text, no tags", "plain text, no tags"), ("<p>open", "open"),
        ("<article><p>a<!-- open comment", "a"), ("</div></p><article>x</article>", "x"), ("<article></article>", ""),
        ("<article><p>&amp;lt;</p></article>", "&lt;"), ("<article>1 < 2 & 3 > 2</article>", "1 < 2 & 3 > 2"),
        ("<div class='has-sidebar'><main><p>a</p><div id=shareBar>b</div></main></div>", "a"),
        ("<main><p>a</p></main><div id='comments'><article><p>b</p></article></div>", "a"),
        ("<article>a</article><article class='userComment'>b</article>", "a"),
        ("<script>never ends <p>x", ""), ("<article><p class='lead'>a</p><div hidden>b</div></article>", "a"),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_ratios_decide_below_containers_too():
    body = "".join(f"<h2>Part {i}</h2><p>{words(i, 40)}, {words(i + 90, 20)}. {words(i + 50, 30)}.</p>" for i in range(5))
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(12))
    # A link list inside main is left out; the headings of the text stay.
    text = html_extract.main_text(f"<main>{body}<ul>{links}</ul></main>")
    assert "link" not in text and text.count("Part") == 5 and text.count("\n") == 9
    # A teaser in a sidebar neither hides the text of the page nor is content.
    teaser = "<div class='sidebar'><article><p>Read this next, it is a teaser.</p></article></div>"
    text = html_extract.main_text(f"{teaser}<div>{body}</div>")
    assert "teaser" not in text and words(4, 40) in text
    assert "teaser" in html_extract.main_text(teaser)
    assert "teaser" in html_extract.main_text(f"<p>skip</p>{teaser.replace('sidebar', 'has-sidebar')}")


def test_pages_as_rows(spark):
    rows = [(i, "u", p, "x", "y") for i, p in enumerate([PAGE, None, "", PAGE])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string, text string")
    got = {r.id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got[1] == got[2] == "" and got[0] == got[3] == html_extract.main_text(PAGE)
    assert html_extract.extract_pages(pages.limit(0)).collect() == []
