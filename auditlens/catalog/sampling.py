"""Caps, samples, splits, vocabularies and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import HASH_RANGE
from ..functions.text import tokens_alnum, tokens_strict, tokens_ws
from ..operators import sampling, vocabulary
from ..operators.sets import split_classes
from ..plans.sequences import prepare_sequences
from . import CATALOG
from .tables import (
    COMMANDS,
    LABELLED,
    LINES,
    PROCESS,
    SPACE,
    commands,
    labelled,
    lines,
    process_commands,
    sql_hash,
    sql_position,
    table,
)

SQL_PATTERN = r"""case when regexp_matches(command, '^grep -w [0-9]+') then 'grep'
  when regexp_matches(command, '^readlink /proc/[0-9]+/exe') then 'readlink'
  when regexp_matches(command, '^top -p [0-9]+ -bn 1') then 'top'
  when regexp_matches(command, '^(/[\p{L}\p{N}_]+)+/jstat -gc [0-9]+') then 'jstat'
  when regexp_matches(command, '^cp -rf /opt/webserver/') then 'cp' end"""


@CATALOG.query(
    f"""with {PROCESS}, named as (select command, {SQL_PATTERN} as pattern from (select distinct command from process))
    select command from named where pattern is null
    union all
    select command from (
      select command from named where pattern is not null
      qualify row_number() over (partition by pattern order by md5('0|' || command), command) <= 500)"""
)
def capped_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_patterns(process_commands(spark, sf_dir).select("command").distinct())


@CATALOG.query(
    """select o_orderkey from orders
       qualify row_number() over (order by md5('7|' || o_orderkey), o_orderkey) <= 1000"""
)
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(table(spark, sf_dir, "orders"), 1000, "o_orderkey", 7).select("o_orderkey")


@CATALOG.query(
    f"""select o_orderkey, {sql_position('o_orderkey', 3)} as position from orders"""
)
def shuffled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


@CATALOG.query(
    """select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as position from orders"""
)
def sorted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return sampling.range_position(rows, ["o_totalprice", "o_orderkey"]).select(
        "o_orderkey", F.col("position").cast("bigint").alias("position")
    )


@CATALOG.query("select doc_id as cmd_id, md5('5|' || doc_id) as shuffle_key from documents")
def shuffle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffle(commands(spark, sf_dir), "cmd_id", 5).select("cmd_id", "shuffle_key")


@CATALOG.query(
    f"""select {sql_hash('o_orderkey', 42)} < {int(0.3 * HASH_RANGE)} as is_test, count(*) as n,
        cast(sum(o_orderkey) as bigint) as keys from orders group by 1"""
)
def train_test_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = sampling.train_test_split(table(spark, sf_dir, "orders"), 0.3, "o_orderkey")
    sides = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return sides.groupBy("is_test").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@CATALOG.query(
    f"""with ranked as (select o_orderkey, {sql_position('o_orderkey')} <= 3000 as taken from orders)
    select taken, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from ranked group by taken"""
)
def take_and_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    taken, skipped = sampling.take_skip(rows, 3000, "o_orderkey")
    sides = taken.withColumn("taken", F.lit(True)).unionByName(skipped.withColumn("taken", F.lit(False)))
    return sides.groupBy("taken").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@CATALOG.query(
    """select doc_id as cmd_id, ntile(5) over (order by md5('0|' || doc_id), doc_id) - 1 as fold from documents"""
)
def folds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.k_fold(commands(spark, sf_dir).select("cmd_id"), 5, "cmd_id")


@CATALOG.query("select doc_id as cmd_id, ntile(7) over (order by doc_id) - 1 as fold from documents")
def folds_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.k_fold(commands(spark, sf_dir).select("cmd_id"), 7, "cmd_id", shuffled=False)


@CATALOG.query(
    f"""select split, {sql_hash("split || '|' || doc_id")} < {int(0.2 * HASH_RANGE)} as is_test, count(*) as n,
        cast(sum(doc_id) as bigint) as keys
    from documents cross join range(10) as s(split) group by all"""
)
def random_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = sampling.shuffle_split(commands(spark, sf_dir).select("cmd_id"), 10, 0.2, "cmd_id")
    return splits.groupBy("split", "is_test").agg(F.count("*").alias("n"), F.sum("cmd_id").alias("keys"))


@CATALOG.query(
    f"""with {LABELLED}, models as (select count(*) // 60 as n from labelled where label = 0)
    select cmd_id, label, cast((position - 1) // 10 as bigint) as model from (
      select cmd_id, label, {sql_position('cmd_id')} as position from labelled where label = 0)
    where position <= (select n from models) * 10
    union all
    select cmd_id, label, i from labelled cross join (select unnest(range(n)) as i from models) where label = 1"""
)
def bagging_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = split_classes(labelled(spark, sf_dir).select("cmd_id", "label"))
    return sampling.bagging_chunks(normal, abnormal, "cmd_id", chunk=10, step=60)


# --- vocabularies ------------------------------------------------------------------------------

SQL_WS = f"list_filter(string_split_regex(command, '{SPACE}+'), lambda x: x <> '')"


def sql_vocabulary(rows: str) -> str:
    return f"""select token, {sql_position('token')} as token_id
      from (select distinct unnest({SQL_WS}) as token from {rows})"""


@CATALOG.query(f"with {COMMANDS} {sql_vocabulary('commands')}")
def token_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(commands(spark, sf_dir))


EXTENDED = f"""base as ({sql_vocabulary('(select * from commands where label = 1)')}),
    fresh as (
      select distinct unnest({SQL_WS}) as token from commands where label = 0),
    extended as (
      select token, token_id from base
      union all
      select token, {sql_position('token')} + (select max(token_id) from base)
      from fresh where token not in (select token from base))"""


@CATALOG.query(f"with {COMMANDS}, {EXTENDED} select token, token_id from extended")
def extended_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = split_classes(commands(spark, sf_dir))
    return vocabulary.build_vocabulary(normal, base=vocabulary.build_vocabulary(abnormal))


@CATALOG.query(
    f"""with {COMMANDS}, vocabulary as ({sql_vocabulary('(select * from commands where label = 0)')}),
    occurrences as (select cmd_id, unnest(range(len(t))) as pos, unnest(t) as token
                    from (select cmd_id, string_split(command, ' ') as t from commands))
    select cmd_id, count(*) as tokens, count(*) filter (where token_id is null) as unknown,
           md5(string_agg(cast(coalesce(token_id, -1) as varchar), ',' order by pos)) as digest
    from occurrences left join vocabulary using (token) group by cmd_id"""
)
def encoded_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commands(spark, sf_dir)
    normal, _ = split_classes(rows)
    ids = vocabulary.encode(rows, vocabulary.build_vocabulary(normal, tokens_ws), tokens_strict)
    return ids.select(
        "cmd_id",
        F.size("ids").cast("bigint").alias("tokens"),
        F.size(F.filter("ids", lambda i: i == -1)).cast("bigint").alias("unknown"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"),
    )


def _sequence_sql(first: str, seed: str) -> str:
    return f"""select cmd_id, label, position, batch_id, tokens, longest, digest from (
      select *, cast((position - 1) // 128 as bigint) as batch_id,
             max(tokens) over (partition by (position - 1) // 128) as longest
      from (select *, {sql_position('cmd_id', seed)} as position from shuffled where {first}))"""


@CATALOG.query(
    rf"""with {COMMANDS},
    trimmed as (select cmd_id, label, regexp_extract_all(command, '[\p{{L}}\p{{N}}_]+') as t from commands),
    vocabulary as (select token, {sql_position('token')} as token_id
                   from (select distinct unnest(t) as token from trimmed)),
    occurrences as (select cmd_id, unnest(range(len(t))) as pos, unnest(t) as token from trimmed),
    ids as (select cmd_id, md5(string_agg(cast(token_id as varchar), ',' order by pos)) as digest
            from occurrences join vocabulary using (token) group by cmd_id),
    shuffled as (select cmd_id, label, cast(len(t) as bigint) as tokens, digest, {sql_position('cmd_id')} as place
                 from trimmed join ids using (cmd_id))
    select 'test' as side, * from ({_sequence_sql('place <= 300', '0')})
    union all
    select 'train', * from ({_sequence_sql('place > 300', '0-train')})"""
)
def padded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = prepare_sequences(commands(spark, sf_dir), take=300)
    sides = test.withColumn("side", F.lit("test")).unionByName(train.withColumn("side", F.lit("train")))
    words = F.filter("ids", lambda i: i != 0)
    return sides.select(
        "side",
        "cmd_id",
        "label",
        "position",
        "batch_id",
        F.size(words).cast("bigint").alias("tokens"),
        F.size("ids").cast("bigint").alias("longest"),
        F.md5(F.array_join(words.cast("array<string>"), ",")).alias("digest"),
    )


@CATALOG.query(
    rf"""with {LINES}
    select token, {sql_position('token')} as token_id
    from (select distinct unnest(regexp_extract_all(command, '[\p{{L}}\p{{N}}_]+')) as token from lines)"""
)
def sequence_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(lines(spark, sf_dir), tokens_alnum)
