"""Removal of a site's repeated lines by their site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.session import materialize

RATIO = 0.1
MIN_PAGES = 3

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
UNSEEN = r"(?is)<!--.*?-->|<(?:script|style|head)\b.*?</(?:script|style|head)\s*>"
INLINE = r"(?i)</?(?:a|abbr|b|big|code|em|font|i|mark|q|s|small|span|strong|sub|sup|time|u)(?:\s[^>]*)?/?>"
TAG = r"<[a-zA-Z/!?][^>]*>"
SPACE = r"[ \t\f\r\x0B]+"


def host_of(url: Column) -> Column:
    """Host of an address in lower case; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Visible lines of a page: text between block tags and line ends, white space collapsed, without empty ones."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "\n"), INLINE, ""), TAG, "\n")
    pieces = F.split(F.regexp_replace(text, SPACE, " "), " ?\n[ \n]*")
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Drop every line that more than `ratio` of its host's pages hold, and at least `min_pages` of them.

    `pages` has page_id, host and lines (array of text). Returns page_id, host, n_lines, n_dropped and text (kept lines
    joined by line ends), one row per input row.

    A line counts once per page. Counts per host and line are added up in the tasks before they are shuffled. A host's
    boilerplate is one short array: lines above the ratio are at most the mean number of lines per page divided by
    it, however many pages the host has. Adaptive execution splits a host with very many pages, or sends the arrays to all.

    Null or empty host: those pages are one site. Null or empty lines: nothing to drop, empty text. Repeated rows count as
    pages. Null page_id is passed on. Lines are compared by 64-bit hashes. Empty input: empty result.
    """
    pages = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("dropped"))
    frequent = materialize(frequent, "line-boilerplate")
    marked = pages.join(frequent, "host", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<bigint>")))
    kept = F.filter("lines", lambda x: ~F.array_contains("dropped", F.xxhash64(x)))
    return marked.select("page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
