"""The corpus operators over the given tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (
    bpe,
    conversations,
    embedding_dedup,
    exact_dedup,
    html_extract,
    minhash,
    mixing,
    phrases,
    piece_table,
    ppm,
    quality,
    sharding,
    url_filter,
)
from .common import id_remainder

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return shards.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def quality_ranking(spark: SparkSession, sf_dir: str) -> quality.Ranking:
    """Fitted on the labelled documents whose crc32 of the id as text is not 1 modulo 3."""
    marks = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")
    )
    marks = marks.where(id_remainder(F.col("id"), 3) != 1)
    return quality.fit_ranking(*quality.training_rows(_table(spark, sf_dir, "documents"), marks))


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, sf_dir, "documents"), quality_ranking(spark, sf_dir))
    return scored.select(
        F.col("id").alias("doc_id"),
        (id_remainder(F.col("id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


OP4_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
from d join g using (text_sha256)"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    wide = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return html_extract.extract_pages(wide, key="page").select(
        "id.page_id", "id.url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


def op7_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


OP7_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select vec_id as node, vec_id as seen from v
  union
  select r.node, l.b from reach r join links l on r.seen = l.a)
select v.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select node, min(seen) as component_id from reach group by node) c on c.node = v.vec_id
left join (select a, count(*) as n_links from links group by a) n on n.a = v.vec_id"""


def op8_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ppm.score_documents(docs, ppm.held_out_rows(F.col("doc_id"))).withColumnRenamed("id", "doc_id")


def op9_gbt_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "block_score")


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "source",
        "rate",
        "copies",
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Conversations with known faults: a row's crc32 of ``conv_id:turn`` decides whether it is dropped, emptied,
    stripped of sentence ends, repeated or given the role user. Nulls are one space each."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    told = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))).alias("time"),
    )
    return told.drop("time")


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    report = conversations.conversation_report(damaged_conversations(rows))
    asked = rows.select("conv_id").distinct().select("conv_id", F.struct("conv_id").alias("key"))
    # A conversation that lost all its turns has no row in the report.
    told = report.withColumn("key", F.struct(F.col("id").alias("conv_id"))).drop("id")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    whole = asked.join(told, "key", "left").drop("key").fillna(zeros)
    return whole.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
    )


def op12_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


OP12_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
occ as (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from w), (values (1), (2), (3)) s(size)
  where i + size - 1 <= len(w)),
f as (select lang, size, phrase, count(*) as f from occ group by all),
tot as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
cand as (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from f where size > 1 and f >= 10),
cut as (
  select c.lang, c.phrase, c.size, c.w, c.a, l.f as l, r.f as r, k,
    ((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f))::bigint as score
  from (select *, unnest(range(1, size)) as k from cand) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1 :], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select lang, phrase, max(f) as f from (
    select lang, unnest([array_to_string(w[1 : size - 1], ' '), array_to_string(w[2 :], ' ')]) as phrase, a as f
    from cand where size > 2) group by all),
kept as (
  select b.* from best b left join held h on h.lang = b.lang and h.phrase = b.phrase
  where h.f is null or 100 * h.f < 50 * b.a),
ranked as (
  select lang, phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join tot using (lang) where rank <= 2000"""


def op13_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return piece_table.token_digests(docs, public_tokenizers.path(PIECES)).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    found = (
        op1_kd_sharding,
        op2_minhash_dedup,
        op3_bradley_terry_quality,
        op4_exact_dedup,
        op5_html_extraction,
        op6_forced_boundary_bpe,
        op7_int8_embedding_dedup,
        op8_ppm_scoring,
        op9_gbt_url_filter,
        op10_entropy_mixing,
        op11_viterbi_repair,
        op12_trie_collocations,
        op13_piece_table,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op7_int8_embedding_dedup": OP7_SQL, "op12_trie_collocations": OP12_SQL}
