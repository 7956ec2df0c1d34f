"""Queries for the operators inside a text: filters, sections, chunks, links, translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.functions import boilerplate, chunks, links
from feedsieve.operators import translate
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import table, texts
from feedsieve.plans.catalog import query
from feedsieve.plans.join_queries import CACHE, cache_table

# The prose has no boilerplate of its own: sponsor and header lines are put between its lines by position.
_INSERTS = ("Sponsors:", "* Brand one", "This episode is sponsored by Acme", "Learn more at acme", "Visit acme now", "Sign up", "Go to acme", "Chapters", "promo code ROGAN", "")


def with_boilerplate(text):
    """Every line of a text followed by one of the fixed lines, chosen by its place."""
    extra = F.array(*[F.lit(s) for s in _INSERTS])
    lines = F.transform(F.split(text, "\n", -1), lambda s, i: F.concat(s, F.lit("\n"), F.get(extra, i % len(_INSERTS))))
    return F.array_join(lines, "\n")


@query("filter_blocks")
def filter_blocks(spark, sf):
    docs = texts(spark, sf).select("doc_id", boilerplate.filter_blocks(with_boilerplate(F.col("text")), "\n").alias("f"))
    return docs.select("doc_id", "f.text", F.array_join("f.removed_reasons", ",").alias("removed_reasons"),
                       *[F.coalesce(F.try_element_at(f"f.{m}", F.lit(c)), F.lit(0)).alias(f"{m[:4]}_{c}")
                         for m, c in (("kept_category_counts", "body"), ("kept_category_counts", "chapters"), ("removed_category_counts", "sponsor"))])


@query("filter_lines")
def filter_lines(spark, sf):
    return texts(spark, sf).select("doc_id", boilerplate.filter_lines(with_boilerplate(F.col("text"))).alias("text"))


def _sections_sql() -> str:
    # Paragraphs are lines here; a long paragraph is packed by sentences or sliced.
    return f"""
WITH p AS (SELECT doc_id, pno, para FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS para, generate_subscripts(string_split(t, chr(10)), 1) AS pno
    FROM (SELECT doc_id, {q.clean_display('text')} AS t FROM documents)) WHERE para <> ''),
s AS (SELECT *, regexp_extract_all(para, '(?s).+?[。！？.!?]+|.+$') AS parts FROM (SELECT doc_id, pno, trim(para) AS para FROM p)),
c AS (SELECT doc_id, pno, CASE WHEN length(para) <= 300 OR NOT regexp_matches(para, '[\\s。！？.!?]') THEN [para]
    WHEN len(list_filter(parts, lambda x: length(x) > 300)) > 0 THEN list_transform(range(0, length(para), 300), lambda i: substring(para, CAST(i AS BIGINT) + 1, 300))
    ELSE string_split(list_reduce(parts, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) <= 300 THEN a || x ELSE a || chr(1) || x END), chr(1)) END AS pieces FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pno, i) AS INT) AS section_no, pieces[i] AS section FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM c)"""


@query("split_sections", _sections_sql())
def split_sections(spark, sf):
    spaced = F.regexp_replace("text", "\n+", "\n\n")
    out = texts(spark, sf).select("doc_id", F.posexplode(chunks.split_sections(spaced, 300)).alias("at", "section"))
    return out.select("doc_id", (F.col("at") + 1).alias("section_no"), "section")


def _paragraphed(text):
    """Every fourth line break becomes a blank line; some paragraphs open with a heading."""
    lines = F.transform(F.split(F.trim(text), "\n+", -1), lambda s, i: F.when(i == 0, s).when(i % 8 == 4, F.concat(F.lit("\n\nLinks:\n"), s))
                        .when(i % 4 == 0, F.concat(F.lit("\n\n"), s)).otherwise(F.concat(F.lit("\n"), s)))
    return F.array_join(lines, "")


_PARA = """
lined AS (SELECT doc_id, string_split_regex(trim(text), '\\n+') AS ls FROM documents),
texted AS (SELECT doc_id, array_to_string(list_transform(range(0, len(ls)), lambda i: CASE WHEN i = 0 THEN ls[1] WHEN i % 8 = 4 THEN chr(10) || chr(10) || 'Links:' || chr(10) || ls[i + 1]
  WHEN i % 4 = 0 THEN chr(10) || chr(10) || ls[i + 1] ELSE chr(10) || ls[i + 1] END), '') AS t FROM lined)"""
_S = q.strip
_CHUNKS = f"""
WITH {_PARA.strip()},
paras AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({_S('t')}, '\\n\\s*\\n'), lambda x: {_S('x')}), lambda x: x <> '') AS ps FROM texted)),
units AS (SELECT doc_id, n, p, CASE WHEN length(p) <= 400 THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_S('x')}), lambda x: x <> '') END AS us FROM paras),
pieces AS (SELECT doc_id, n, string_split(list_reduce(us, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) <= 400 THEN a || ' ' || x ELSE a || chr(1) || x END), chr(1)) AS ps FROM units),
flat AS (SELECT doc_id, flatten(list(ps ORDER BY n)) AS all_pieces FROM pieces GROUP BY doc_id),
packed AS (SELECT doc_id, string_split(list_reduce(all_pieces, lambda a, x: CASE WHEN NOT regexp_matches(trim(split_part(x, chr(10), 1)), '(?i)^(?:links?|additional\\s+reading|resources?|chapters?|timestamps?)\\s*[:：]?\\s*$|^(?:corrections?|disclaimers?)\\b')
   AND length(string_split(a, chr(1))[-1]) + 2 + length(x) <= 400 THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1)) AS cs FROM flat)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, cs[i] AS chunk FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM packed)"""


@query("pack_chunks", _CHUNKS)
def pack_chunks(spark, sf):
    docs = texts(spark, sf).select("doc_id", _paragraphed(F.col("text")).alias("t"))
    return translate.chunk_table(docs, "doc_id", "t", 400)


@query("chunk_structure", """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'resources' WHEN 1 THEN 'chapters' WHEN 2 THEN 'correction' WHEN 3 THEN 'disclaimer' WHEN 4 THEN 'resources' ELSE '' END AS kind FROM documents""")
def chunk_structure(spark, sf):
    heads = F.array(*[F.lit(s) for s in ("Additional  Reading ：", "timestamps", "Corrections to an earlier item", "DISCLAIMER: none", "link:", "Links here", "Resource list")])
    whole = F.concat(F.get(heads, (F.col("doc_id") % 7).cast("int")), F.lit("\n"), F.col("text"))
    return texts(spark, sf).select("doc_id", chunks.chunk_structure(whole).alias("kind"))



@query("extract_urls", """
WITH u AS (SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, 'href="/', 'href="http://site.test/', 'g'), '(?:https?://|www\\.)[^\\s<>''"]+'), lambda x: rtrim(x, '.,)]），。')) AS us FROM pages)
SELECT page_id, array_to_string(list_filter(us, lambda x, i: list_position(us, x) = i AND x <> ''), ' ') AS urls FROM u""")
def extract_urls(spark, sf):
    absolute = F.regexp_replace("html", 'href="/', 'href="http://site.test/')
    return table(spark, sf, "pages").select("page_id", F.array_join(links.extract_urls(absolute), " ").alias("urls"))


@query("append_missing_urls", f"""
WITH u AS (SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, 'href="/', 'href="http://site.test/', 'g'), '(?:https?://|www\\.)[^\\s<>''"]+'), lambda x: rtrim(x, '.,)]），。')) AS us FROM pages),
d AS (SELECT page_id, list_filter(us, lambda x, i: list_position(us, x) = i AND x <> '') AS us, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'see ' || us[1] || ' done' END AS out FROM u),
m AS (SELECT page_id, {_S('out')} AS out, list_filter(us, lambda x: NOT contains(out, x)) AS miss FROM d)
SELECT page_id, CASE WHEN len(miss) = 0 THEN out ELSE out || CASE WHEN out = '' THEN '' ELSE chr(10) || chr(10) END || '原文链接：' || array_to_string(list_transform(miss, lambda x: chr(10) || '- ' || x), '') END AS output FROM m""")
def append_missing_urls(spark, sf):
    absolute = F.regexp_replace("html", 'href="/', 'href="http://site.test/')
    docs = table(spark, sf, "pages").select("page_id", absolute.alias("html")).withColumn("first", F.get(links.extract_urls(F.col("html")), F.lit(0)))
    out = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("see "), F.col("first"), F.lit(" done")))
    return docs.select("page_id", links.append_missing_urls(F.col("html"), out).alias("output"))


@query("untranslated_lines", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_S('x')}), lambda x: x <> '') AS ls FROM documents),
k AS (SELECT doc_id, list_filter(ls, lambda x, i: list_position(ls, x) = i) AS ls, ls AS every FROM l)
SELECT doc_id, array_to_string(list_filter(ls, lambda x: len(list_filter(every, lambda y, j: y = x AND (j - 1) % 2 = 0)) > 0 AND len(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9''’.-]*')) >= 4
  AND NOT regexp_matches(x, '^\\(?\\d{{1,2}}:\\d{{2}}')), '|') AS copied FROM k""")
def untranslated_lines(spark, sf):
    # The output keeps every second line of the source.
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c\xa0　"))), lambda s: s != "")
    docs = texts(spark, sf).select("doc_id", "text", F.array_join(F.transform(lines, lambda s, i: F.when(i % 2 == 0, s).otherwise("译文")), "\n").alias("out"))
    return docs.select("doc_id", F.array_join(links.untranslated_lines(F.col("text"), F.col("out")), "|").alias("copied"))


@query("resource_fallback", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN rtrim('延伸阅读（原文）：' || chr(10) || {_S('text')}, chr(10)) WHEN 1 THEN '延伸阅读（原文）：' ELSE '' END AS kept FROM documents""")
def resource_fallback(spark, sf):
    mode = F.col("doc_id") % 3
    chunk = F.when(mode == 0, F.concat(F.lit("Links:\n"), F.col("text"))).when(mode == 1, " resources \n").otherwise(F.col("text"))
    return texts(spark, sf).select("doc_id", links.resource_fallback(chunk).alias("kept"))


def _shout(chunk: str, target: str) -> str:
    """Stand-in translator: fails on some chunks, returns nothing for others."""
    if len(chunk) % 7 == 0:
        raise ValueError("busy")
    return "" if len(chunk) % 11 == 0 else f"[{target}] {chunk}"


@query("translate_chunks", f"""
WITH cut AS ({_CHUNKS}), r AS (SELECT doc_id, chunk_index, CASE WHEN length(chunk) % 7 = 0 THEN 'exception' WHEN length(chunk) % 11 = 0 THEN 'empty_translation' END AS err, '[zh] ' || chunk AS out FROM cut)
SELECT doc_id, count(*) AS chunk_count, count(*) FILTER (err IS NULL) AS translated_chunk_count, coalesce(string_agg(out, chr(10) || chr(10) ORDER BY chunk_index) FILTER (err IS NULL), '') AS translated_text,
  CASE WHEN count(err) = 0 THEN 'ok' WHEN count(*) > count(err) THEN 'partial_failed' ELSE 'failed' END AS status,
  coalesce(string_agg(chunk_index || ':' || err, ',' ORDER BY chunk_index) FILTER (err IS NOT NULL), '') AS errors FROM r GROUP BY doc_id""")
def translate_chunks(spark, sf):
    docs = texts(spark, sf).select("doc_id", _paragraphed(F.col("text")).alias("t"))
    out = translate.translate_chunks(docs, "doc_id", "t", _shout, 400)
    listed = F.transform("errors", lambda e: F.concat_ws(":", e["chunk_index"].cast("string"), e["error_type"]))
    return out.select("doc_id", "chunk_count", "translated_chunk_count", "translated_text", "status", F.coalesce(F.array_join(listed, ","), F.lit("")).alias("errors"))


@query("translate_with_cache", f"""
WITH {CACHE.strip()} SELECT doc_id, CASE WHEN NOT wanted THEN 'skipped' WHEN status = 'ok' THEN 'cache_hit' ELSE 'translated' END AS status, wanted AS should_translate,
  wanted AND coalesce(status = 'ok', false) AS cache_hit FROM keyed LEFT JOIN cache USING (k)""")
def translate_with_cache(spark, sf):
    docs = texts(spark, sf).select(
        "doc_id", F.col("source").alias("podcast_id"), F.lit("").alias("episode_id"), F.lit("").alias("episode_url"), F.lit("en").alias("language"), "text")
    return translate.translate_with_cache(docs, cache_table(spark, sf), "doc_id", "text").select("doc_id", "status", "should_translate", "cache_hit")


def shown_items(spark, sf):
    none = F.lit(None).cast("string")
    return texts(spark, sf).select(
        "doc_id", with_boilerplate(F.col("text")).alias("show_notes_text"), none.alias("show_notes"), none.alias("description"),
        F.lit(None).cast("array<string>").alias("summary_3_sentences_cn"), none.alias("one_line_summary_cn"), F.col("lang").alias("language"),
        (F.col("doc_id") % 6 == 0).alias("show_notes_truncated"), F.lit("description").alias("show_notes_source"), F.col("n_chars").cast("int").alias("show_notes_text_len"))


@query("display_result")
def display_result(spark, sf):
    out = translate.display_result(shown_items(spark, sf), "doc_id")
    return out.select("doc_id", "heading", F.size("sections").alias("n_sections"), F.sha1(F.array_join("sections", "\n")).alias("sections_hash"), "translation_status",
                      "detected_language", "should_translate", F.array_join("removed_reasons", ",").alias("removed_reasons"), "completeness.suspected_source_truncation")
