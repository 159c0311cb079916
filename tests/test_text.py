from __future__ import annotations

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from auditlens.functions import text as T
from auditlens.functions.common import run_counts
from auditlens.functions.distance import ngram_distance, token_distance
from auditlens.functions.lexical import LEXICAL_COLUMNS, lexical_features
from auditlens.functions.markup import extract_blocks, extract_links


def apply(spark, function, values, *args):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    out = rows.select("i", function(F.col("c"), *args).alias("r")).orderBy("i").collect()
    return [list(r["r"]) if isinstance(r["r"], list) else r["r"] for r in out]


def test_nul_handling(spark):
    values = ["java\0-D\0", "\0ls\0-l\0", "\0\0", "", None]
    assert apply(spark, T.nul_to_space, values) == ["java -D ", " ls -l ", "  ", "", None]
    assert apply(spark, T.nul_join, values) == ["java -D", "ls -l", "", "", None]


WHITE = ["  a b ", "\ta b　", "a  b", "", " ", "a\x1cb c", "a\nb"]


def test_whitespace_agrees_with_python(spark):
    assert apply(spark, T.strip, WHITE) == [v.strip() for v in WHITE]
    assert apply(spark, T.tokens_ws, WHITE) == [v.split() for v in WHITE]
    assert apply(spark, T.tokens_strict, WHITE) == [v.split(" ") for v in WHITE]


def test_word_and_alnum_tokens(spark):
    values = ["Ls -la /etc/Passwd_1 é éa A9", "x y", ""]
    assert apply(spark, T.tokens_word, values) == [re.findall(r"\b\w\w+\b", v.lower()) for v in values]
    assert apply(spark, T.tokens_alnum, values) == [re.findall(r"\w+", v) for v in values]


def test_program_path_and_name(spark):
    values = ["bash -x /a/b.sh y", "sh", "sh -c", "/bin/sh -e x", "/usr/bin/ls -l", "", "  ls", "bash", "sh a -b", None]
    paths = ["/a/b.sh", None, None, "x", "/usr/bin/ls", None, "", None, "a", None]
    assert apply(spark, T.program_path, values) == paths
    names = ["b.sh", None, None, "x", "ls", None, "", None, "a", None]
    assert apply(spark, T.program_name, values) == names


def test_canonical_java(spark):
    values = ["/opt/jdk/bin/java -jar  x", "java", "javac x", "/usr/java/ls"]
    assert apply(spark, T.canonical_java, values) == ["java -jar  x", "java ", "javac x", "/usr/java/ls"]


def test_prompt_cleaner_comment(spark):
    values = [
        "# comment",
        "// comment",
        "[root@h ~]# ls -l ",
        "$ ls",
        "a # b $ c",
        "a#b#c#d",
        "#$",
        "http://x",
        "ls  # list",
        "plain",
        "",
    ]
    want = [None, None, "ls -l", " ls", " b ", None, None, "http:", "ls  ", "plain", None]
    assert apply(spark, T.clean_prompt_comment, values) == want


def test_prompt_cleaner_redirect(spark):
    values = ["[root@h ~]# ls ", "$ ls", "a > b", "a < b > c", "a#b#c#d", "$#", "plain ", ""]
    assert apply(spark, T.clean_prompt_redirect, values) == ["ls", "ls", "a", "b", None, None, "plain", None]


def entropy(text: str) -> float:
    return round(sum(-n / len(text) * math.log2(n / len(text)) for n in collections.Counter(text).values()), 7)


def test_entropy_and_counts(spark):
    values = ["aaaa", "abcd", "a\nb a", "漢字漢😀", " ls ls ls "]
    assert apply(spark, T.char_entropy, values) == pytest.approx([entropy(v) + 0.0 for v in values], abs=1e-7)
    assert apply(spark, T.char_entropy, ["", None]) == [0.0, None]


def test_char_entropy_counts_each_character_once(spark):
    """Code points count, white space too; no copy of the text is made per distinct character."""
    values = ["\U0001f600a\U0001f600a", "a\nb\n", "aaaa"]
    assert apply(spark, T.char_entropy, values) == [1.0, 1.5, 0.0]
    plan = spark.createDataFrame([("ab",)], "t string").select(T.char_entropy(F.col("t")))
    assert "replace" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert apply(spark, T.substr_count, values, " ls ") == [v.count(" ls ") for v in values]


def test_ngrams(spark):
    grams = lambda c, n: T.ngrams(T.tokens_strict(c), n)
    assert apply(spark, grams, ["a b c", "a b", "a", ""], 2) == [["a b", "b c"], ["a b"], None, None]
    assert apply(spark, grams, ["a b c", ""], 1) == [["a", "b", "c"], [""]]


def test_category_and_url(spark):
    assert apply(spark, T.clean_category, ["A | B", "一、文件", "plain"]) == ["AB", "文件", "plain"]
    assert apply(spark, T.absolute_url, ["ls.html", "/linux/ls.html"], "/linux/") == ["/linux/ls.html"] * 2


def test_run_counts(spark):
    counts = lambda c: run_counts(F.split(c, " "))
    got = apply(spark, counts, ["b a b", "x"])
    assert [[tuple(e) for e in row] for row in got] == [[("a", 1), ("b", 2)], [("x", 1)]]
    empty = spark.range(1).select(run_counts(F.array().cast("array<string>")).alias("r")).first()["r"]
    assert empty == []


def python_token_distance(a, b):
    return (len(a) + len(b) - 2 * len(set(a) & set(b))) / (len(a) + len(b))


def test_distances(spark):
    pairs = [(["a"], ["a"]), (["a"], ["b"]), (["a", "a"], ["a", "a"]), (["a", "", ""], ["", "b"]), (["a", "b"], ["b", "a"])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r["d"] for r in rows.select("i", token_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [python_token_distance(a, b) for a, b in pairs]
    assert got[2] == 0.5
    bigrams = rows.select("i", ngram_distance(F.col("a"), F.col("b"), 2).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in bigrams] == [None, None, 0, 3, 2]


def test_lexical_features(spark):
    rows = [
        ("java\0-Dx='a''b'\0ls\0ls\0", "java"),
        ("sudo yum cat > /etc/passwd; x.sh | y ${z} (a) 10%", "java"),
        ("ignored", "sh"),
        ("", "java"),
    ]
    audit = spark.createDataFrame(rows, "ccmdline string, pname string")
    got = {r["ccmdline"]: r.asDict() for r in lexical_features(audit).collect()}
    assert set(got) == {"java -Dx='a''b' ls ls ", rows[1][0]}
    first, second = got["java -Dx='a''b' ls ls "], got[rows[1][0]]
    assert (first["len"], first["paramnum"], first["single_quotes"], first["ls"], first["defines"]) == (21, 4, 2.0, 1, 1)
    assert [second[c] for c in ("redirects", "semicolons", "dollars", "percents", "pipes")] == [1] * 5
    assert [second[c] for c in ("parentheses", "braces", "yum", "etc", "passwd", "shell_script")] == [1] * 6
    assert second["sudo"] == 0 and len(LEXICAL_COLUMNS) == 22


PAGE = """<h2>实例</h2><pre>wrong</pre><h3>other</h3><pre>no</pre>
<h3 class="x"> <b>例子</b></h3><p>t</p><pre>ls -l
  # c
[root@h ~]# cat &lt;a&gt;</pre><a href="x.html" title="ls">go <b>on</b></a><pre>pwd</pre>"""


def test_blocks_and_links(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, "<h3>only</h3>")], "page_id long, html string")
    found = extract_blocks(pages, titles=("实例", "例子")).orderBy("page_id", "block", "line_no").collect()
    assert [(r["page_id"], r["block"], r["line_no"], r["line"]) for r in found] == [
        (1, 0, 0, "ls -l"),
        (1, 0, 1, "# c"),
        (1, 0, 2, "[root@h ~]# cat <a>"),
        (1, 1, 0, "pwd"),
    ]
    heads = extract_blocks(pages, heading_tags=("h3",), lines="first").orderBy("block").collect()
    assert [r["line"] for r in heads] == ["ls -l\n  # c\n[root@h ~]# cat <a>", "pwd"]
    links = [(r["page_id"], r["pos"], r["href"], r["title"], r["text"]) for r in extract_links(pages).collect()]
    assert links == [(1, 0, "x.html", "ls", "go on")]
