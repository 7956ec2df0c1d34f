"""Queries for counts, summaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.functions import boilerplate
from feedsieve.operators import background, quality
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import lite_decisions, table, texts, with_lite
from feedsieve.plans.catalog import query

_COUNTS = ", ".join(f"count(*) FILTER (decision = '{d}') AS \"{d}\"" for d in ("full", "preview", "skip"))


@query("decision_counts", with_lite(f"SELECT run_id, count(*) AS total, {_COUNTS} FROM lite GROUP BY run_id"))
def decision_counts(spark, sf):
    return quality.decision_counts(lite_decisions(spark, sf), ["run_id"])


@query("podcast_count", with_lite("""
SELECT run_id, count(DISTINCT coalesce(nullif(CASE WHEN item_pos % 3 = 0 THEN '' ELSE podcast_id END, ''), nullif(CASE WHEN item_pos % 5 = 0 THEN '' ELSE podcast_name END, ''))) AS podcast_count
FROM lite GROUP BY run_id"""))
def podcast_count(spark, sf):
    rows = lite_decisions(spark, sf).withColumns({
        "podcast_id": F.when(F.col("item_pos") % 3 == 0, "").otherwise(F.col("podcast_id")),
        "podcast_name": F.when(F.col("item_pos") % 5 == 0, "").otherwise(F.col("podcast_name"))})
    return quality.podcast_count(rows, ["run_id"])


_STATUS = "['translated', 'cache_hit', 'partial_translated', 'partial_cache_hit', 'failed', 'partial_failed'][CAST(item_pos % 6 AS INT) + 1]"


@query("translation_summary", with_lite("""
SELECT run_id, count(*) AS episode_count, count(*) FILTER (w) AS eligible_count, count(*) FILTER (w AND s IN ('translated', 'cache_hit')) AS translated_count,
  count(*) FILTER (w AND s LIKE 'partial_%' AND s <> 'partial_failed') AS partial_count, count(*) FILTER (w AND s IN ('failed', 'partial_failed')) AS failed_count,
  count(*) FILTER (NOT w) AS skipped_count, count(*) FILTER (w AND s LIKE '%cache_hit') AS cache_hit_count,
  count(*) FILTER (w AND s NOT IN ('failed', 'partial_failed')) AS visible_translation_count,
  coalesce(string_agg(podcast_name || '/' || item_pos || '/' || s, ';' ORDER BY item_pos) FILTER (w AND s IN ('failed', 'partial_failed') AND frn <= 20), '') AS failed
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, (w AND s IN ('failed', 'partial_failed')) ORDER BY item_pos) AS frn FROM st) GROUP BY run_id""",
    f"st AS (SELECT run_id, item_pos, podcast_name, language = 'en' AS w, {_STATUS} AS s FROM lite)"))
def translation_summary(spark, sf):
    names = F.array(*[F.lit(s) for s in ("translated", "cache_hit", "partial_translated", "partial_cache_hit", "failed", "partial_failed")])
    rows = lite_decisions(spark, sf).withColumns({
        "should_translate": F.col("language") == "en", "status": F.get(names, (F.col("item_pos") % 6).cast("int")),
        "episode_title": F.col("item_pos").cast("string")}).withColumn("cache_hit", F.endswith("status", F.lit("cache_hit")))
    out = quality.translation_summary(rows, ["run_id"], ["item_pos"])
    listed = F.transform("failed_episodes", lambda e: F.concat_ws("/", e["podcast"], e["title"], e["status"]))
    return out.withColumn("failed", F.coalesce(F.array_join(listed, ";"), F.lit(""))).drop("failed_episodes")


_PRIMARY, _SECONDARY, _WEAK = ("blog.",), ("example.com",), ("page=2",)
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SNIPPET = "regexp_extract(html, '(?s)<p>([^<]*)</p>', 1)"
_GRADE = f"""CASE WHEN {q.has_any('lower(url)', _PRIMARY)} THEN 'primary' WHEN {q.has_any(f'lower({_TITLE})', _WEAK)} OR {q.has_any('lower(url)', _WEAK)} THEN 'weak'
  WHEN length({_SNIPPET}) < 10 AND NOT {q.has_any('lower(url)', _SECONDARY)} THEN 'weak' ELSE 'secondary' END"""


def _graded(spark, sf):
    title, snippet = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "(?s)<p>([^<]*)</p>", 1)
    return table(spark, sf, "pages").select("page_id", quality.source_quality(title, F.col("url"), snippet, _PRIMARY, _SECONDARY, _WEAK).alias("quality"))


@query("source_quality", f"SELECT page_id, {_GRADE} AS quality FROM pages")
def source_quality(spark, sf):
    return _graded(spark, sf)


@query("source_quality_rollup", f"""
SELECT topic, p AS primary_count, s AS secondary_count, w AS weak_count, CASE WHEN p > 0 THEN 'primary' WHEN s > 0 AND (w = 0 OR s > w) THEN 'secondary' ELSE 'weak' END AS quality
FROM (SELECT page_id % 50 AS topic, count(*) FILTER (g = 'primary') AS p, count(*) FILTER (g = 'secondary') AS s, count(*) FILTER (g = 'weak') AS w
  FROM (SELECT page_id, {_GRADE} AS g FROM pages) GROUP BY 1)""")
def source_quality_rollup(spark, sf):
    return quality.source_quality_rollup(_graded(spark, sf).withColumn("topic", F.col("page_id") % 50), ["topic"])


@query("guest_rollup", """
WITH g AS (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS t, length(text) AS n,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS c, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'primary' ELSE 'secondary' END AS sq,
  1 + (conv_id + turn) % 4 AS k FROM conversations WHERE turn < 2),
s AS (SELECT conv_id, turn, i, 's' || turn || '_' || i AS title, sq FROM (SELECT *, unnest(range(0, k)) AS i FROM g) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) <= 5)
SELECT g.conv_id, string_agg(t, '；' ORDER BY turn) AS background, string_agg('note ' || turn, ' | ' ORDER BY turn) AS note,
  CASE WHEN bool_or(c = 'high') THEN 'high' WHEN bool_or(c = 'medium') THEN 'medium' WHEN bool_or(c = 'low') THEN 'low' ELSE 'unknown' END AS confidence,
  any_value(x.titles) AS sources, CASE WHEN any_value(x.best) THEN 'primary (episode_show_notes)' ELSE 'secondary' END AS quality
FROM g JOIN (SELECT conv_id, string_agg(title, ',' ORDER BY turn, i) AS titles, bool_or(sq = 'primary') AS best FROM s GROUP BY conv_id) x USING (conv_id) GROUP BY g.conv_id""")
def guest_rollup(spark, sf):
    n = F.col("conv_id") + F.col("turn")
    grade = F.when(n % 3 == 0, "primary").otherwise("secondary")
    sources = F.transform(F.sequence(F.lit(0).cast("bigint"), n % 4), lambda i: F.struct(
        F.concat(F.lit("s"), F.col("turn").cast("string"), F.lit("_"), i.cast("string")).alias("title"), F.lit("").alias("url"), F.lit("").alias("snippet"), grade.alias("quality")))
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item_pos"), F.col("turn").alias("guest_no"), F.col("text").alias("background_zh"), sources.alias("sources"),
        F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "unknown")]), (n % 4 + 1).cast("int")).alias("confidence"),
        F.concat(F.lit("note "), F.col("turn").cast("string")).alias("note"))
    out = background.guest_rollup(rows)
    return out.select(
        F.col("item_pos").alias("conv_id"), F.col("guest_background_zh").alias("background"), F.col("guest_background_note").alias("note"),
        F.col("guest_background_confidence").alias("confidence"), F.array_join("guest_background_sources.title", ",").alias("sources"),
        F.col("source_quality_summary").alias("quality"))



@query("filter_category_counts", """
WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda b: lower(trim(b))), lambda b: b <> '') AS bs FROM documents)
SELECT doc_id, len(bs) - len(list_filter(bs, lambda b: regexp_matches(b, '^(?:resources?|links|read more)\\s*:?$'))) AS body,
  len(list_filter(bs, lambda b: regexp_matches(b, '^(?:resources?|links|read more)\\s*:?$'))) AS resources FROM lines""")
def filter_category_counts(spark, sf):
    out = texts(spark, sf).select("doc_id", boilerplate.filter_blocks(F.col("text"), "\n").alias("f"))
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", *[F.coalesce(F.try_element_at("f.kept_category_counts", F.lit(c)), zero).alias(c) for c in ("body", "resources")])
