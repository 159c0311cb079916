"""Text functions over documents, lines, events, pages and process commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LEXICAL_COUNTERS
from ..functions import text as T
from ..functions.lexical import LEXICAL_COLUMNS, lexical_features
from ..functions.markup import extract_blocks, extract_links
from ..operators.sets import augment_sudo, strip_commands
from . import CATALOG
from .tables import (
    COMMANDS,
    LINES,
    PROCESS,
    SPACE,
    WORD,
    commands,
    digest,
    lines,
    process_commands,
    sql_digest,
    sql_entropy,
    table,
)


@CATALOG.query(
    """select doc_id as cmd_id, md5(replace(replace(text, ' ', chr(0)) || chr(0), chr(0), ' ')) as digest
       from documents"""
)
def nul_to_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace("command", F.lit(" "), F.lit(T.NUL)), F.lit(T.NUL))
    return commands(spark, sf_dir).select("cmd_id", F.md5(T.nul_to_space(raw)).alias("digest"))


@CATALOG.query(
    """select doc_id as cmd_id,
              md5(replace(trim(chr(0) || replace(text, ' ', chr(0)) || chr(0), chr(0)), chr(0), ' ')) as digest
       from documents"""
)
def nul_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(T.NUL), F.replace("command", F.lit(" "), F.lit(T.NUL)), F.lit(T.NUL))
    return commands(spark, sf_dir).select("cmd_id", F.md5(T.nul_join(raw)).alias("digest"))


@CATALOG.query(
    f"""with {LINES}
    select doc_id, pos, md5(regexp_replace(regexp_replace(padded, '^{SPACE}+', ''), '{SPACE}+$', '')) as digest
    from (select doc_id, pos, chr(9) || ' ' || command || '  ' as padded from lines where command <> '')"""
)
def stripped_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("command <> ''")
    padded = rows.withColumn("command", F.concat(F.lit("\t "), "command", F.lit("  ")))
    return strip_commands(padded).select("doc_id", "pos", F.md5("command").alias("digest"))


@CATALOG.query(
    """select event_id, event_type, json_extract_string(props, '$.k') as k,
              json_extract_string(props, '$.missing') as missing from events"""
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        T.json_field(F.col("props"), "$.k").alias("k"),
        T.json_field(F.col("props"), "$.missing").alias("missing"),
    )


SHELLS = """shells as (
  select doc_id, pos,
         case pos % 5 when 0 then 'bash -x ' || command when 1 then '/bin/sh -e -c ' || command
                      when 2 then 'sh -' when 3 then '/usr/bin/' || command else command end as command
  from lines)"""

PROGRAM = """case when command = '' then null
     when t[1] like '%bash' or t[1] = 'sh' or t[1] like '%/sh'
       then list_filter(t[2:], lambda x: not starts_with(x, '-'))[1]
     else t[1] end"""


def shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind different ways to start a program."""
    kind = F.col("pos") % 5
    return lines(spark, sf_dir).withColumn(
        "command",
        F.when(kind == 0, F.concat(F.lit("bash -x "), "command"))
        .when(kind == 1, F.concat(F.lit("/bin/sh -e -c "), "command"))
        .when(kind == 2, F.lit("sh -"))
        .when(kind == 3, F.concat(F.lit("/usr/bin/"), "command"))
        .otherwise(F.col("command")),
    )


@CATALOG.query(
    f"""with {LINES}, {SHELLS}
    select doc_id, pos, {PROGRAM} as program
    from (select *, string_split(command, ' ') as t from shells)"""
)
def program_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shells(spark, sf_dir).select("doc_id", "pos", T.program_path(F.col("command")).alias("program"))


@CATALOG.query(
    f"""with {LINES}, {SHELLS}
    select doc_id, pos, list_last(string_split({PROGRAM}, '/')) as program
    from (select *, string_split(command, ' ') as t from shells)"""
)
def program_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shells(spark, sf_dir).select("doc_id", "pos", T.program_name(F.col("command")).alias("program"))


@CATALOG.query(
    f"""with {PROCESS}
    select l_orderkey, cast(l_linenumber as integer) as l_linenumber,
           case when t[1] = 'java' or t[1] like '%/java' then 'java ' || array_to_string(t[2:], ' ')
                else command end as command
    from (select *, string_split(command, ' ') as t from process)"""
)
def canonical_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_commands(spark, sf_dir).select(
        "l_orderkey",
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        T.canonical_java(F.col("command")).alias("command"),
    )


def _prompt_sql(split: str, pick: str, skip: str) -> str:
    return f"""with {LINES},
    prompted as (
      select doc_id, pos, case pos % 4 when 0 then '[root@host ~]# ' || command when 1 then '$ ' || command
                                       when 2 then replace(command, ' ', ' > ') else command end as line
      from lines),
    parts as (
      select doc_id, pos, trim(line) as line,
             list_filter(string_split_regex(trim(line), '{split}'), lambda x: x <> '') as p from prompted)
    select doc_id, pos, {pick} as command from parts where {skip}"""


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("pos") % 4
    return lines(spark, sf_dir).select(
        "doc_id",
        "pos",
        F.when(kind == 0, F.concat(F.lit("[root@host ~]# "), "command"))
        .when(kind == 1, F.concat(F.lit("$ "), "command"))
        .when(kind == 2, F.replace("command", F.lit(" "), F.lit(" > ")))
        .otherwise(F.col("command"))
        .alias("line"),
    )


@CATALOG.query(
    _prompt_sql(
        "[#$]|//",
        """case when len(p) = 2 and contains(p[1], '[') then trim(p[2]) when len(p) in (1, 2) then p[1]
                when len(p) = 3 then p[2] end""",
        "not starts_with(line, '#') and not starts_with(line, '//') and len(p) between 1 and 3",
    )
)
def prompt_lines_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _prompted(spark, sf_dir).select(
        "doc_id", "pos", T.clean_prompt_comment(F.col("line")).alias("command")
    )
    return cleaned.where("command is not null")


@CATALOG.query(
    _prompt_sql(
        "[#$><]",
        """nullif(case when len(p) = 2 and contains(p[1], '[') then trim(p[2])
                       when len(p) in (1, 2) then trim(p[1]) when len(p) = 3 then trim(p[2]) end, '')""",
        "len(p) between 1 and 3",
    ).replace("select doc_id, pos, nullif", "select * from (select doc_id, pos, nullif")
    + ") where command is not null"
)
def prompt_lines_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _prompted(spark, sf_dir).select(
        "doc_id", "pos", T.clean_prompt_redirect(F.col("line")).alias("command")
    )
    return cleaned.where("command is not null")


@CATALOG.query(
    f"""with {LINES}, raised as (
      select case when label = 1 then 'sudo ' || command else command end as command from lines
      where command <> '')
    select command, count(*) as n from (
      select command from raised union all
      select 'sudo ' || command from raised where string_split(command, ' ')[1] <> 'sudo')
    group by command"""
)
def sudo_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raised = lines(spark, sf_dir).where("command <> ''").select(
        F.when(F.col("label") == 1, F.concat(F.lit("sudo "), "command"))
        .otherwise(F.col("command"))
        .alias("command")
    )
    return augment_sudo(raised).groupBy("command").agg(F.count("*").alias("n"))


@CATALOG.query(
    """select doc_id as cmd_id, cast(len(string_split(text, ' ')) as bigint) as tokens,
              cast(length(text) as bigint) as characters, length(text) > 1000 as is_long from documents"""
)
def command_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).select(
        "cmd_id",
        T.command_length(F.col("command")).cast("bigint").alias("tokens"),
        F.length("command").cast("bigint").alias("characters"),
        (F.length("command") > 1000).alias("is_long"),
    )


def _token_sql(tokens: str) -> str:
    return f"""select doc_id as cmd_id, cast(len(t) as bigint) as tokens, {sql_digest('t')} as digest
    from (select doc_id, {tokens} as t from documents)"""


def _tokens(spark: SparkSession, sf_dir: str, tokenizer) -> DataFrame:
    rows = commands(spark, sf_dir).select("cmd_id", tokenizer(F.col("command")).alias("t"))
    return rows.select("cmd_id", F.size("t").cast("bigint").alias("tokens"), digest(F.col("t")).alias("digest"))


@CATALOG.query(_token_sql("string_split(text, ' ')"))
def tokens_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.tokens_strict)


@CATALOG.query(_token_sql(f"list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '')"))
def tokens_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.tokens_ws)


@CATALOG.query(_token_sql(f"regexp_extract_all(lower(text), '{WORD}')"))
def tokens_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.tokens_word)


@CATALOG.query(_token_sql(r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"))
def tokens_alnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.tokens_alnum)


@CATALOG.query(
    f"""select doc_id as cmd_id, cast(len(g) as bigint) as ngrams, {sql_digest('g')} as digest from (
      select doc_id, case when len(t) >= 3 then
        list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) end as g
      from (select doc_id, string_split(text, ' ') as t from documents))"""
)
def token_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = commands(spark, sf_dir).select(
        "cmd_id", T.ngrams(T.tokens_strict(F.col("command")), 3).alias("g")
    )
    return grams.select("cmd_id", F.size("g").cast("bigint").alias("ngrams"), digest(F.col("g")).alias("digest"))


@CATALOG.query(
    f"with {LINES} select doc_id, pos, {sql_entropy('command')} as entropy from lines"
)
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", T.char_entropy(F.col("command")).alias("entropy"))


@CATALOG.query(
    """select doc_id as cmd_id,
       cast((length(text) - length(replace(text, 'th', ''))) / 2 as integer) as th,
       cast((length(text) - length(replace(text, ' the ', ''))) / 5 as integer) as the
       from documents"""
)
def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("command")
    return commands(spark, sf_dir).select(
        "cmd_id", T.substr_count(text, "th").alias("th"), T.substr_count(text, " the ").alias("the")
    )


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as process-audit records: NUL-separated command, the language as parent."""
    c = F.col
    return table(spark, sf_dir, "documents").select(
        F.concat(F.replace("text", F.lit(" "), F.lit(T.NUL)), F.lit(T.NUL)).alias("ccmdline"),
        F.concat(F.lit("/usr/bin/"), c("lang")).alias("cexe"),
        c("lang").alias("cname"),
        c("doc_id").cast("string").alias("cpid"),
        c("source").alias("pcmdline"),
        F.concat(F.lit("/opt/"), c("source")).alias("pexe"),
        F.when(c("lang") == "en", F.lit("java")).otherwise(c("lang")).alias("pname"),
        c("n_chars").cast("string").alias("ppid"),
    )


def sql_lexical(key: str) -> str:
    """The lexical counters of English documents beside the columns ``key``; ``c`` is the command."""

    def count(needle: str, divisor: int) -> str:
        quoted = needle.replace("'", "''")
        number = f"cast((length(c) - length(replace(c, '{quoted}', ''))) / {len(needle)} as integer)"
        return f"cast({number} / {divisor} as double)" if divisor > 1 else f"cast({number} as double)"

    counters = ",\n".join(f"{count(needle, d)} as {name}" for name, needle, d in LEXICAL_COUNTERS)
    return f"""select {key},
      cast(length(c) - 1 as double) as len,
      cast(len(list_filter(string_split_regex(c, '{SPACE}+'), lambda x: x <> '')) as double) as paramnum,
      {sql_entropy('c')} as entropy,
      {counters}
    from (select doc_id, text || ' ' as c from documents where lang = 'en')"""


@CATALOG.query(sql_lexical("md5(c) as command"))
def lexical_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = lexical_features(audit_records(spark, sf_dir))
    return features.select(F.md5("ccmdline").alias("command"), *LEXICAL_COLUMNS)


@CATALOG.query(
    f"with {COMMANDS} select cmd_id, case when label = 0 then 1 else -1 end as signed from commands"
)
def signed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).select("cmd_id", T.signed_label(F.col("label")).alias("signed"))


@CATALOG.query(
    """select page_id, list_last(string_split(replace(raw, ' | ', ''), '、')) as category,
              case when contains(link, '/') then link else '/linux/' || link end as url
       from (select page_id, '一、' || page_id || ' | ' || substr(url, 1, 12) as raw,
                    case when page_id % 2 = 0 then url else 'page' || page_id end as link from pages)"""
)
def category_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("一、"), "page_id", F.lit(" | "), F.substring("url", 1, 12))
    link = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("page"), "page_id"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.clean_category(raw).alias("category"), T.absolute_url(link, "/linux/").alias("url")
    )


@CATALOG.query(
    r"""select page_id, pos, regexp_extract(a, '^<a\s[^>]*?href="([^"]*)"', 1) as href,
       nullif(regexp_extract(a, '^<a\s[^>]*?title="([^"]*)"', 1), '') as title,
       trim(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'g'),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as text
    from (select page_id, unnest(range(len(l))) as pos, unnest(l) as a
          from (select page_id, regexp_extract_all(html, '(?s)<a\s[^>]*>.*?</a>') as l from pages))
    where regexp_matches(a, '^<a\s[^>]*?href="')"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_links(table(spark, sf_dir, "pages"))


@CATALOG.query(
    r"""select page_id, block, line_no, trim(line) as line from (
      select page_id, block, unnest(range(len(s))) as line_no, unnest(s) as line from (
        select page_id, block, string_split(replace(replace(replace(replace(replace(
            regexp_replace(regexp_extract(body, '(?s)<p\b[^>]*>(.*?)</p>', 1), '<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)) as s
        from (select page_id, unnest(range(len(l))) as block, unnest(l) as body
              from (select page_id, regexp_extract_all(
                      regexp_extract(html, '(?s)^.*<h1\b[^>]*>.*?</h1>(.*)$', 1),
                      '(?s)<p\b[^>]*>.*?</p>') as l from pages))))"""
)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_blocks(table(spark, sf_dir, "pages"), heading_tags=("h1",), block_tag="p")


@CATALOG.query(
    r"""select page_id, block, cast(0 as bigint) as line_no, line from (
        select page_id, block, string_split(trim(replace(replace(replace(replace(replace(
            regexp_replace(regexp_extract(body, '(?s)<p\b[^>]*>(.*?)</p>', 1), '<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), chr(13) || chr(10))[1] as line
        from (select page_id, unnest(range(len(l))) as block, unnest(l) as body
              from (select page_id, regexp_extract_all(
                      regexp_extract(html, '(?s)<h1\b[^>]*>(.*)$', 1),
                      '(?s)<p\b[^>]*>.*?</p>') as l from pages)))"""
)
def page_block_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_blocks(table(spark, sf_dir, "pages"), heading_tags=("h1",), block_tag="p", lines="first")

