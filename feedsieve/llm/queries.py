"""Thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from feedsieve.llm import audit, benchmark, jaccard, lines, mixing, negatives, pages, quality, sharding, substrings, suffixes, tokens, vectors
from feedsieve.llm.common import table
from feedsieve.session import new_folder, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return register


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|17'), 1, 15))::BIGINT AS key, row_number() OVER () AS r
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized),
levels AS (SELECT *, (3 * source_size)::DOUBLE AS most, 3 * source_size / weight AS level FROM ranked),
filled AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left, sum(source_size) OVER () AS budget
  FROM levels WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, weight, CASE WHEN full_before + level * weight_left <= budget THEN most ELSE weight * (
           SELECT max((budget - full_before) / weight_left) FROM filled WHERE full_before + level * weight_left > budget) END AS target
  FROM filled),
placed AS (
  SELECT d.*, source_size, weight, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
queue AS (
  SELECT r, size, sum(size) OVER (ORDER BY (epoch * source_size + upto) / weight, key, doc_id, source, size, r, epoch ROWS UNBOUNDED PRECEDING) AS queued
  FROM placed, range(3) e(epoch) WHERE size > 0),
got AS (SELECT r, count(*) AS copies FROM queue WHERE queued <= (SELECT sum(size) FROM docs) GROUP BY r)
SELECT doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken FROM placed LEFT JOIN got USING (r)
"""


@query("op1_extract_html")
def op1(spark, sf):
    return pages.extract(table(spark, sf, "pages"))


LINES_SQL = r"""
WITH cleaned AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, row_number() OVER () AS r,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(?:script|style|head)\b.*?</(?:script|style|head)\s*>', chr(10), 'g'),
           '(?i)</?(?:a|abbr|b|big|code|em|font|i|mark|q|s|small|span|strong|sub|sup|time|u)(?:\s[^>]*)?/?>', '', 'g'), '<[a-zA-Z/!?][^>]*>', chr(10), 'g'), '[ \t\f\r\x0B]+', ' ', 'g') AS text
  FROM pages),
split AS (SELECT page_id, host, r, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM cleaned),
seen AS (SELECT DISTINCT host, r, unnest(lines) AS line FROM split),
totals AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
frequent AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line) JOIN totals USING (host) WHERE n >= 3 AND n > 0.1 * pages),
placed AS (SELECT r, host, line, pos FROM (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split)),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM placed p WHERE NOT EXISTS (SELECT 1 FROM frequent f WHERE f.host = p.host AND f.line = p.line) GROUP BY r)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, coalesce(text, '') AS text FROM split LEFT JOIN kept USING (r)
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark, sf):
    return lines.drop_boilerplate(table(spark, sf, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.lines_of(F.col("html")).alias("lines")))


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS low FROM good UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node),
parts AS (SELECT node, min(low) AS low FROM reach GROUP BY node), counts AS (SELECT ra, count(*) AS n FROM links GROUP BY ra)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(low, vec_id) AS kept
FROM v LEFT JOIN counts ON ra = r LEFT JOIN parts ON node = vec_id
"""


@query("op3_embedding_dedup", VECTORS_SQL)
def op3(spark, sf):
    return vectors.near_duplicate_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("op4_quality_classifier")
def op4(spark, sf):
    return quality.classify(table(spark, sf, "documents").select("doc_id", "text")).select("doc.doc_id", "n_words", "score", "kept")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, r, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
flat AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node),
parts AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, low AS component_id FROM sets LEFT JOIN parts ON node = doc_id
"""


@query("op5_jaccard_join", JACCARD_SQL)
def op5(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


LEAKS_SQL = r"""
WITH w AS (SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
items AS (SELECT item_id, len(ws) AS m, least(len(ws), 5) AS size, list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ')) AS v FROM b WHERE len(ws) > 0),
docs AS (SELECT DISTINCT doc_id, r, size, list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' ')) AS g FROM w, (SELECT DISTINCT size FROM items) WHERE len(ws) >= size),
fd AS (SELECT r, size, len(g) AS n, unnest(g) AS k, generate_subscripts(g, 1) AS p FROM docs),
fi AS (SELECT item_id, size, len(v) AS n, unnest(v) AS k, generate_subscripts(v, 1) AS p FROM items),
places AS (SELECT DISTINCT r, size, item_id, fd.p, fd.n AS total, fi.n AS long, least(fd.n, fi.n) AS wide FROM fd JOIN fi USING (size, k)),
covering AS (SELECT r, size, item_id, s FROM (SELECT *, unnest(range(greatest(1, p - wide + 1), least(p, total - wide + 1) + 1)) AS s FROM places)
  GROUP BY r, size, item_id, s, long, wide HAVING 7 * count(*) >= 3 * (long + wide)),
in_place AS (SELECT DISTINCT r, size, item_id, greatest(1, least(fd.p - fi.p + 1, fd.n - fi.n + 1)) AS s, 1 AS hit FROM fd JOIN fi USING (size, k)),
windows AS (SELECT doc_id, r, item_id, s, m, v, coalesce(hit, 0) AS hit, g[s:s + len(v) - 1] AS x FROM covering JOIN docs USING (r, size) JOIN items USING (item_id, size) LEFT JOIN in_place USING (r, size, item_id, s)),
scored AS (SELECT *, list_sum(list_transform(list_distinct(v), lambda e: least(len(list_filter(v, lambda y: y = e)), len(list_filter(x, lambda y: y = e)))))::BIGINT AS shared FROM windows),
rated AS (SELECT *, shared / (len(v) + len(x) - shared) AS similarity FROM scored)
SELECT doc_id, item_id, similarity, (s - 1)::INT AS start, m::INT AS n_words FROM rated WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, hit DESC, s) = 1
"""


@query("op6_decontaminate", LEAKS_SQL)
def op6(spark, sf):
    return benchmark.contaminated(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text")).drop("row")


@query("op7_suffix_dedup")
def op7(spark, sf):
    return suffixes.remove_repeated_bytes(table(spark, sf, "documents").select("doc_id", "text"))


@query("op8_mix_sources", MIX_SQL)
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_shard")
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", *sharding.size_and_digest(F.col("text")))
    return sharding.every_slot(sharding.shard(docs)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
covered AS (SELECT r, i FROM windows JOIN firsts USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT r, i + j AS p FROM covered, range(50) t(j)),
words AS (SELECT r, p, ws[p] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""


@query("op10_substring_dedup", WINDOWS_SQL)
def op10(spark, sf):
    return substrings.remove_repeated_windows(table(spark, sf, "documents").select("doc_id", "text"))


@query("op11_token_files")
def op11(spark, sf):
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    tokens.write(table(spark, sf, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


AUDIT_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < docs.doc_id, false)::INT AS bits
  FROM docs JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = docs.doc_id),
cells AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, bits),
letters AS (SELECT substr('ABCDE', i::INT, 1) AS f, (1 << (i::INT - 1)) AS bit FROM range(1, 6) t(i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, s::INT AS step, bits[s::INT] AS bit, coalesce(list_sum(bits[1:s::INT - 1]), 0)::INT AS before FROM orders, range(1, 6) t(s)),
counts AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (cells.bits & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (cells.bits & bit <> 0 AND cells.bits & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (cells.bits & bit <> 0 AND cells.bits & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (cells.bits = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (cells.bits & bit <> 0 AND cells.bits & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (cells.bits & bit <> 0 AND cells.bits & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark, sf):
    return audit.audit(table(spark, sf, "documents").select("doc_id", "text", "source"), table(spark, sf, "labels").select("doc_id", "quality", "toxic"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS r
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark, sf):
    vectors_ = table(spark, sf, "embeddings")
    return negatives.hard_negatives(vectors_.select("vec_id", negatives.relabelled(F.col("label"), F.col("vec_id")).alias("label"), "embedding"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
