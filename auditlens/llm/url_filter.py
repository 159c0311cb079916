"""URL verdicts: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs, at most ``TRAIN_ROWS`` distinct ones, picked by a hash of the URL, each
weighted by its rows. Features are lengths, depth, digit share, entropy, parameter counts, and statistics of
the host's suffix: how many of all URLs share it and the smoothed share of blocked ones among labelled URLs,
both counted over every row.

* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there
  up to ``?``, ``#`` or the end; a null URL or one without ``://`` has both empty, as strings
* a rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins
* without labels of both classes every verdict of the method is the only class seen, else ``allow``
* rows that repeat are judged alike; other columns are never read; an empty table gives an empty result
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_entropy
from .common import join_groups

TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 4
SMOOTHING = 20.0

# The rules of the contract as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

LEXICAL = (
    "url_length",
    "host_length",
    "path_length",
    "host_labels",
    "depth",
    "digit_share",
    "hyphens",
    "entropy",
    "parameters",
    "has_fragment",
    "secure",
    "suffix_share",
    "suffix_blocked",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, chosen).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Add the features that need one row only to (url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]+")).cast("double"),
            "digit_share": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "entropy": F.coalesce(char_entropy(F.concat("host", "path")), F.lit(0.0)),
            "parameters": F.regexp_count(query, F.lit("[^&=]+=")).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": F.startswith(F.lower(F.substring(url, 1, 8)), F.lit("https://")).cast("double"),
        }
    )


def with_suffix_statistics(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add suffix_share over all of ``urls`` and suffix_blocked over ``labelled`` (suffix, label)."""
    rows = urls.groupBy("suffix").agg(F.count("*").alias("n"))
    marks = labelled.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("m"))
    totals = urls.agg(F.count("*").alias("total")).crossJoin(
        labelled.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("base"))
    )
    blocked = (F.coalesce("blocked", F.lit(0)) + SMOOTHING * F.col("base")) / (F.coalesce("m", F.lit(0)) + SMOOTHING)
    table = (
        rows.join(marks, "suffix", "left")
        .join(F.broadcast(totals))
        .select("suffix", "n", (F.col("n") / F.col("total")).alias("suffix_share"), blocked.alias("suffix_blocked"))
    )
    return join_groups(urls, table, ["suffix"], "n").drop("n")


def fit_trees(training: DataFrame) -> GBTClassificationModel | None:
    """Trees on rows with ``LEXICAL``, label (1: block) and weight; None unless both classes occur."""
    if training.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(LEXICAL), outputCol="lexical").transform(training)
    return GBTClassifier(
        labelCol="label",
        featuresCol="lexical",
        weightCol="weight",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=0.2,
        seed=5,
    ).fit(assembled.select("lexical", "label", "weight"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) of every row.

    ``labelled`` (url, label 1: block) trains the trees; without it they learn from the URLs that a rule
    settles, and so carry the rules' judgement over to hosts that no rule names.
    """
    from ..session import stored

    def parsed(frame: DataFrame, *more: Column) -> DataFrame:
        kept = frame.select(F.col(url).alias("url"), *more)
        named = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        return named.withColumn("suffix", suffix_of(F.col("host")))

    rows = parsed(pages, F.col(key).alias("id")).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        marked = rows.where("best is not null").select(
            "url", "host", "path", "suffix", (F.col("best.verdict") == "block").cast("double").alias("label")
        )
    else:
        marked = parsed(labelled, F.col("label").cast("double").alias("label")).where("label in (0, 1)")
    # The bound is on what the trees are fitted to; the suffix statistics take every labelled row.
    distinct = marked.groupBy("url", "host", "path", "suffix", "label").agg(F.count("*").cast("double").alias("weight"))
    sample = stored(
        distinct.orderBy(F.xxhash64(F.lit(61), "url"), "url", "label").limit(train_rows), "labelled-urls"
    )
    table = with_suffix_statistics(rows, marked.select("suffix", "label"))
    suffixes = table.select("suffix", "suffix_share", "suffix_blocked").distinct()
    training = stored(
        lexical_features(sample.join(suffixes, "suffix", "left")).select(
            *[F.coalesce(f, F.lit(0.0)).alias(f) for f in LEXICAL], "label", "weight"
        ),
        "training-urls",
    )
    model = fit_trees(training)
    if model is None:
        only = training.agg(F.max("label")).first()[0] or 0.0
        scored = table.withColumn("block_score", F.lit(float(only)))
    else:
        assembled = VectorAssembler(inputCols=list(LEXICAL), outputCol="lexical").transform(lexical_features(table))
        scored = model.transform(assembled).withColumn(
            "block_score", F.get(vector_to_array("probability"), F.lit(1))
        )
    verdict = F.coalesce(
        "best.verdict", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    )
    return scored.select(
        "id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "block_score"
    )
