"""Links and example blocks of stored documentation pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# The entities that occur in command examples.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Text of a fragment: tags removed, basic entities decoded."""
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _group(text: Column, pattern: str) -> Column:
    """First capture group, null (not empty) without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def extract_links(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", container: str | None = None
) -> DataFrame:
    """``(page_id, pos, href, title, text)`` of every link, optionally inside one container tag."""
    source = F.col(html)
    if container:
        inner = F.regexp_extract_all(source, F.lit(rf"(?s)<{container}\b[^>]*>(.*?)</{container}>"), 1)
        source = F.array_join(inner, "\n")
    anchors = F.regexp_extract_all(source, F.lit(r"(?s)<a\s[^>]*>.*?</a>"), 0)
    return (
        pages.select(page_id, F.posexplode(anchors).alias("pos", "anchor"))
        .select(
            page_id,
            F.col("pos").cast("bigint").alias("pos"),
            _group(F.col("anchor"), r'^<a\s[^>]*?href="([^"]*)"').alias("href"),
            _group(F.col("anchor"), r'^<a\s[^>]*?title="([^"]*)"').alias("title"),
            strip(plain_text(F.col("anchor"))).alias("text"),
        )
        .where(F.col("href").isNotNull())
    )


def _after_heading(html: Column, tags: Sequence[str], titles: Sequence[str] | None) -> Column:
    """What follows the first heading with one of the titles (tags tried in order), or the last
    heading when no titles are given; null without one."""
    if titles is None:
        options = [rf"(?s)^.*<{tag}\b[^>]*>.*?</{tag}>(.*)$" for tag in tags]
    else:
        words = "|".join(re.escape(t) for t in titles)
        options = [
            rf"(?s)<{tag}\b[^>]*>(?:\s|<[^>]*>)*(?:{words})(?:\s|<[^>]*>)*</{tag}>(.*)$" for tag in tags
        ]
    return F.coalesce(*[_group(html, p) for p in options])


def extract_blocks(
    pages: DataFrame,
    page_id: str = "page_id",
    html: str = "html",
    heading_tags: Sequence[str] = ("h3", "h2"),
    titles: Sequence[str] | None = None,
    block_tag: str = "pre",
    lines: str = "all",
) -> DataFrame:
    """``(page_id, block, line_no, line)`` of the blocks behind the chosen heading.

    ``lines='all'`` gives every trimmed line, ``'first'`` only the first line of each block.
    """
    rest = _after_heading(F.col(html), heading_tags, titles)
    blocks = F.regexp_extract_all(rest, F.lit(rf"(?s)<{block_tag}\b[^>]*>(.*?)</{block_tag}>"), 1)
    found = pages.select(page_id, F.posexplode(blocks).alias("block", "body")).select(
        page_id, F.col("block").cast("bigint").alias("block"), plain_text(F.col("body")).alias("body")
    )
    if lines == "first":
        first = F.substring_index(strip(F.col("body")), "\r\n", 1)
        return found.select(page_id, "block", F.lit(0).cast("bigint").alias("line_no"), first.alias("line"))
    split = F.transform(F.split(F.col("body"), "\n"), strip)
    return found.select(page_id, "block", F.posexplode(split).alias("line_no", "line")).select(
        page_id, "block", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )
