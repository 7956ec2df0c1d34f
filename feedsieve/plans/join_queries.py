"""Queries for lookups, keyed updates and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.functions import keywords as kw
from feedsieve.operators import dictionary, joins, translate
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import episodes, feed_config, FEEDS, lite_decisions, table, TEST_POLICY, texts, with_episodes, with_lite
from feedsieve.plans.catalog import query
from feedsieve.plans.filter_queries import QUEUE, queue_table
from feedsieve.session import materialize

P = TEST_POLICY


@query("join_feed_config", with_episodes("""
SELECT item_pos, coalesce(f.id, replace(lower(e.podcast_name), ' ', '')) AS podcast_id, coalesce(f.language, 'zh') AS language
FROM episodes e LEFT JOIN (SELECT * FROM feeds WHERE rss_url <> '') f ON f.name = e.podcast_name""", FEEDS))
def join_feed_config(spark, sf):
    config = feed_config(spark, sf).filter(F.col("rss_url") != "").select(F.col("name").alias("podcast_name"), F.col("id").alias("podcast_id"), "language")
    return joins.join_feed_config(episodes(spark, sf, with_texts=False).select("item_pos", "podcast_name"), config).select("item_pos", "podcast_id", "language")


CUT = "2024-01-14 14:00:00"


def registry_table(spark, sf):
    """Registry of the earlier weeks."""
    rows = lite_decisions(spark, sf)
    return rows.filter(F.col("pub_ts") < F.lit(CUT).cast("timestamp")).select(
        "episode_id", "podcast_id", F.concat(F.lit("title "), F.col("item_pos").cast("string")).alias("episode_title"),
        F.date_format("pub_ts", "yyyy-MM-dd").alias("first_seen"), F.col("week_id").alias("first_seen_week_id"), F.date_format("pub_ts", "yyyy-MM-dd").alias("last_seen"),
        (F.col("item_pos") % 60).cast("int").alias("seen_count"), "decision", F.transform(F.sequence(F.lit(1), (F.col("item_pos") % 60 + 1).cast("int")), lambda i: i.cast("string")).alias("statuses"))


REGISTRY = f"""
registry AS (SELECT episode_id, podcast_id, strftime(pub_ts, '%Y-%m-%d') AS first_seen, week_id AS first_seen_week_id, CAST(item_pos % 60 AS INT) AS seen_count, decision,
  list_transform(range(1, item_pos % 60 + 2), lambda i: i::VARCHAR) AS statuses, item_pos FROM lite WHERE pub_ts < TIMESTAMP '{CUT}')"""


@query("join_registry", with_lite("""
SELECT l.item_pos, coalesce(r.first_seen, '2024-02-05') AS first_seen, coalesce(r.first_seen_week_id, l.week_id) AS first_seen_week_id, coalesce(r.seen_count, 0) + 1 AS seen_count,
  r.decision AS previous_decision, array_to_string(list_reverse(list_reverse(list_append(coalesce(r.statuses, []), l.decision))[1:52]), ',') AS statuses
FROM lite l LEFT JOIN registry r USING (episode_id)""", REGISTRY))
def join_registry(spark, sf):
    out = joins.join_registry(lite_decisions(spark, sf).select("item_pos", "episode_id", "decision", "week_id"), registry_table(spark, sf), "2024-02-05", F.col("week_id"))
    return out.select("item_pos", "first_seen", "first_seen_week_id", "seen_count", "previous_decision", F.array_join("statuses", ",").alias("statuses"))


@query("upsert_registry", with_lite("""
SELECT episode_id, CASE WHEN pub_ts >= TIMESTAMP '2024-01-07 14:00:00' THEN 'updated' ELSE decision END AS decision FROM lite"""))
def upsert_registry(spark, sf):
    rows = lite_decisions(spark, sf)
    fresh = rows.filter(F.col("pub_ts") >= F.lit("2024-01-07 14:00:00").cast("timestamp")).select("episode_id", F.lit("updated").alias("decision"))
    return joins.upsert_registry(registry_table(spark, sf), fresh).select("episode_id", "decision")


_LOW = "WITH low AS (SELECT doc_id, lower(text) AS t FROM documents)"


@query("keyword_hits", f"""{_LOW}
SELECT doc_id, {q.hits('t', P.interests.boost)} AS boost_hits, {q.hits('t', P.interests.negative)} AS negative_hits, {q.hits('t', P.interests.topics)} AS topic_hits,
  {q.hits('t', P.action_words)} AS action_hits, {q.hits('t', P.strategic_words)} AS strategic_hits FROM low""")
def keyword_hits(spark, sf):
    likes = P.interests
    lists = {"boost_hits": likes.boost, "negative_hits": likes.negative, "topic_hits": likes.topics, "action_hits": P.action_words, "strategic_hits": P.strategic_words}
    words = tuple(dict.fromkeys(w.lower() for ws in lists.values() for w in ws))
    found = table(spark, sf, "documents").select("doc_id", kw.matched_words(F.lower("text"), words).alias("hits"))
    return found.select("doc_id", *[kw.count_hits(F.col("hits"), ws).alias(n) for n, ws in lists.items()])


# Every word, pair and triple of words of the benchmark texts, in lists by their number of words, and some phrases with marks.
_DICTIONARY = """
bw AS (SELECT list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM benchmark),
dictionary AS (
  SELECT DISTINCT 'words ' || n AS list, array_to_string(w[i:i + n - 1], ' ') AS keyword FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw, (SELECT unnest([1, 2, 3])::INT AS n)))"""


def keyword_dictionary(spark, sf):
    w = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    words = table(spark, sf, "benchmark").select(w.alias("w"), F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("n")).where(F.size("w") >= F.col("n"))
    at = words.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return at.select(F.concat(F.lit("words "), F.col("n").cast("string")).alias("list"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("keyword")).distinct()


# Marks at the edges of words: a keyword stands inside a text where it does with its edges.
_EDGED = r"regexp_replace(regexp_replace({x}, '([\p{{L}}\p{{N}}\p{{M}}_])([^\p{{L}}\p{{N}}\p{{M}}_])', '\1' || chr(1) || '\2', 'g'), '([^\p{{L}}\p{{N}}\p{{M}}_])([\p{{L}}\p{{N}}\p{{M}}_])', '\1' || chr(1) || '\2', 'g')"


@query("keyword_hits_dictionary", f"""WITH {_DICTIONARY.strip()},
d AS (SELECT list, keyword, lower(keyword) AS k, {_EDGED.format(x="' ' || lower(keyword) || ' '")} AS e, regexp_replace(lower(keyword), '([/?# \\t\\n\\r\\x0B\\f])', chr(2) || '\\1', 'g') AS s FROM dictionary),
k AS (SELECT list, keyword, k, chr(1) || trim(e[2:len(e) - 1], chr(1)) || chr(1) AS e, '.' || s || chr(2) AS s FROM d),
t AS (SELECT doc_id, lower(text) AS t, {_EDGED.format(x="' ' || lower(text) || ' '")} AS e, regexp_replace(lower(text), '([/?# \\t\\n\\r\\x0B\\f])', chr(2) || '\\1', 'g') AS s FROM documents)
SELECT doc_id, list, count(*) AS hits FROM t, k WHERE contains(t.t, k.k) AND ((len(k.k) >= 2 AND starts_with(t.t, k.k)) OR (contains(t.e, k.e) AND NOT contains(t.s, k.s)))
GROUP BY doc_id, list""")
def keyword_hits_dictionary(spark, sf):
    return dictionary.dictionary_counts(table(spark, sf, "documents").select("doc_id", "text"), keyword_dictionary(spark, sf))


@query("exclude_hosts", """
WITH n AS (SELECT c_custkey, 'Show ' || c_nationkey AS podcast_name, CASE c_custkey % 4 WHEN 0 THEN 'Supplier ' || c_custkey % 30 WHEN 1 THEN 'Supp' WHEN 2 THEN c_name ELSE 'Supplier ' || c_custkey % 30 || ' jr' END AS name FROM customer),
h AS (SELECT 'Show ' || s_nationkey AS podcast_name, lower('Supplier ' || s_suppkey % 30) AS host FROM supplier)
SELECT c_custkey, name FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.podcast_name = n.podcast_name AND (contains(lower(n.name), host) OR contains(host, lower(n.name))))""")
def exclude_hosts(spark, sf):
    key, mode = F.col("c_custkey"), F.col("c_custkey") % 4
    host = F.concat(F.lit("Supplier "), (key % 30).cast("string"))
    name = F.when(mode == 0, host).when(mode == 1, "Supp").when(mode == 2, F.col("c_name")).otherwise(F.concat(host, F.lit(" jr")))
    names = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Show "), F.col("c_nationkey").cast("string")).alias("podcast_name"), name.alias("name"))
    hosts = table(spark, sf, "supplier").select(F.concat(F.lit("Show "), F.col("s_nationkey").cast("string")).alias("podcast_name"),
                                                F.concat(F.lit("Supplier "), (F.col("s_suppkey") % 30).cast("string")).alias("host"))
    return joins.exclude_hosts(names, hosts).select("c_custkey", "name")


@query("cache_ttl_lookup", """
WITH c AS (SELECT o_orderkey % 5000 AS key, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey, coalesce(floor((epoch(TIMESTAMP '1999-06-01 00:00:00') - epoch(seen)) / 86400) <= CASE WHEN c_custkey % 5000 % 2 = 0 THEN 900 ELSE 300 END, false) AS cache_valid FROM customer LEFT JOIN c ON c.key = c_custkey % 5000""")
def cache_ttl_lookup(spark, sf):
    cache = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").groupBy((F.col("o_orderkey") % 5000).alias("key")).agg(
        F.max("o_orderdate").cast("timestamp").alias("cached_at"))
    cache = cache.withColumns({"detection_status": F.when(F.col("key") % 2 == 0, "confirmed_guest").otherwise("possible_guest"), "payload": F.col("key").cast("string")})
    requests = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5000).alias("key"))
    return joins.cache_ttl_lookup(requests, cache, F.lit("1999-06-01 00:00:00").cast("timestamp"), 900, 300).select("c_custkey", "cache_valid")


def keyed_documents(spark, sf):
    docs = texts(spark, sf).select(
        "doc_id", F.col("source").alias("podcast_id"), F.lit("").alias("episode_id"), F.lit("").alias("episode_url"), F.lit("en").alias("language"), "text")
    return translate.with_translation_key(docs, "text")


def cache_table(spark, sf):
    """Entries for the texts of every third document, some unfinished."""
    # Stored before the empty keys are dropped: a filter on the key would bring its work back to the scan's tasks.
    keyed = materialize(keyed_documents(spark, sf).filter(F.col("doc_id") % 3 == 0).select("doc_id", "cache_key"), "cache-keys").filter("cache_key IS NOT NULL")
    status = F.when(F.max("doc_id") % 2 == 0, "ok").otherwise("failed")
    return keyed.groupBy("cache_key").agg(status.alias("status"), F.concat(F.lit("cached "), F.max("doc_id").cast("string")).alias("translated_text"),
                                         F.lit(1).cast("bigint").alias("chunk_count"), F.lit(1).cast("bigint").alias("translated_chunk_count")).withColumns({
        "localized_fallback_chunk_indices": F.lit(None).cast("array<int>"),
        "errors": F.lit(None).cast("array<struct<chunk_index:int,error_type:string,error:string,localized_fallback:boolean,unchanged_lines:array<string>>>")})


CACHE = f"""
keyed AS (SELECT doc_id, source || '|' || {q.strip("regexp_replace(text, '[\\s]+', ' ', 'g')")} AS k,
  length(regexp_replace(regexp_replace(text, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_.-]+\\.[\\p{{L}}\\p{{N}}_]+\\b', ' ', 'g'), '[^A-Za-z]', '', 'g')) >= 40 AS wanted FROM documents),
cache AS (SELECT k, CASE WHEN max(doc_id) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, 'cached ' || max(doc_id) AS cached FROM keyed WHERE doc_id % 3 = 0 AND wanted GROUP BY k)"""


@query("translation_cache_lookup", f"""
WITH {CACHE.strip()} SELECT doc_id, CASE WHEN wanted AND status = 'ok' THEN 'hit' ELSE 'miss' END AS cache_state, CASE WHEN wanted THEN cached END AS cached_text FROM keyed LEFT JOIN cache USING (k)""")
def translation_cache_lookup(spark, sf):
    return translate.translation_cache_lookup(keyed_documents(spark, sf), cache_table(spark, sf)).select("doc_id", "cache_state", "cached_text")


@query("translation_cache_misses", f"WITH {CACHE.strip()} SELECT doc_id FROM keyed LEFT JOIN cache USING (k) WHERE wanted AND coalesce(status, '') <> 'ok'")
def translation_cache_misses(spark, sf):
    return translate.translation_cache_misses(keyed_documents(spark, sf), cache_table(spark, sf)).select("doc_id")


@query("join_folder_targets", with_lite("""
SELECT item_pos, CASE WHEN feed_ord % 3 = 0 OR decision = 'skip' THEN '' ELSE 'fld_' || podcast_id || '_' || decision END AS folder_id,
  CASE WHEN feed_ord % 3 = 0 OR decision = 'skip' THEN '' ELSE 'http://folders.test/' || podcast_id END AS folder_url FROM lite"""))
def join_folder_targets(spark, sf):
    rows = lite_decisions(spark, sf).select("item_pos", "podcast_id", F.col("decision").alias("action"))
    pods = feed_config(spark, sf).filter(F.substring("id", 4, 9).cast("int") % 3 != 0).select(F.col("id").alias("podcast_id"))
    folders = pods.select("podcast_id", F.explode(F.array(F.lit("full"), F.lit("preview"))).alias("action"))
    folders = folders.withColumns({"folder_id": F.concat_ws("_", F.lit("fld"), "podcast_id", "action"), "folder_url": F.concat(F.lit("http://folders.test/"), F.col("podcast_id"))})
    return joins.join_folder_targets(rows, folders, ["podcast_id", "action"]).select("item_pos", "folder_id", "folder_url")


def run_windows(spark, sf):
    """One run per calendar year of the orders, each covering the second quarter."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    at = lambda m: F.make_timestamp(F.col("y"), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return years.select(F.concat(F.lit("run_"), F.col("y").cast("string")).alias("run_id"), at(4).alias("window_start"), at(7).alias("window_end"))


@query("selection_in_window", """
SELECT 'sel_' || o_orderkey AS selection_id FROM orders WHERE o_orderdate >= make_timestamp(1995 + o_orderkey % 7, 4, 1, 0, 0, 0) AND o_orderdate < make_timestamp(1995 + o_orderkey % 7, 7, 1, 0, 0, 0)
  AND EXISTS (SELECT 1 FROM orders r WHERE year(r.o_orderdate) = 1995 + orders.o_orderkey % 7)""")
def selection_in_window(spark, sf):
    named = table(spark, sf, "orders").select(
        F.concat(F.lit("sel_"), F.col("o_orderkey").cast("string")).alias("selection_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.concat(F.lit("run_"), (F.lit(1995) + F.col("o_orderkey") % 7).cast("string")).alias("run_id"))
    return joins.selection_in_window(named, run_windows(spark, sf)).select("selection_id")


def match_items(spark, sf):
    return episodes(spark, sf).select("podcast_name", "item_pos", F.col("episode_title").alias("title"), F.col("publish_date").alias("pub_date"), F.col("audio_url").alias("enclosure_url"))


def match_requests(spark, sf):
    """Every item asked for by a date, a piece of its title, both, or words that fit nothing."""
    eps = episodes(spark, sf)
    mode = F.col("item_pos") % 5
    return eps.select(
        F.col("item_pos").alias("request_id"), "podcast_name", F.when(mode == 0, "").when(mode == 4, "zq").otherwise(F.substring("episode_title", 1, 12)).alias("hint"),
        F.when(mode.isin(0, 2), F.col("publish_date")).otherwise("").alias("publish_date"))


_MATCH = """
req AS (SELECT item_pos AS request_id, podcast_name, CASE item_pos % 5 WHEN 0 THEN '' WHEN 4 THEN 'zq' ELSE substring(episode_title, 1, 12) END AS hint,
  CASE WHEN item_pos % 5 IN (0, 2) THEN publish_date ELSE '' END AS want FROM episodes),
scored AS (SELECT r.request_id, e.podcast_name, e.item_pos, e.publish_date, CASE WHEN want <> '' AND e.publish_date = want THEN 100 ELSE 0 END
  + 5 * len(list_intersect(list_distinct(regexp_extract_all(lower(hint), '[\\p{L}\\p{N}_]+')), list_distinct(regexp_extract_all(lower(episode_title), '[\\p{L}\\p{N}_]+'))))
  + CASE WHEN hint <> '' AND contains(lower(episode_title), lower(hint)) THEN 20 ELSE 0 END
  + CASE WHEN length(hint) >= 4 AND contains(lower(episode_title), left(lower(hint), 3)) THEN 3 ELSE 0 END AS score
  FROM req r JOIN episodes e USING (podcast_name)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, publish_date DESC, item_pos) = 1)"""


@query("best_match", with_episodes("SELECT request_id, podcast_name, item_pos, CAST(score AS INT) AS score FROM best", _MATCH))
def best_match(spark, sf):
    return joins.best_match(match_requests(spark, sf), match_items(spark, sf))


@query("resolve_audio", with_episodes("""
SELECT b.request_id, b.podcast_name, CASE WHEN err = '' THEN e.audio_url ELSE '' END AS audio_url, CASE WHEN err = '' THEN e.episode_title ELSE '' END AS title,
  CASE WHEN err = '' THEN e.publish_date ELSE '' END AS pub_date, CASE WHEN err = '' THEN 'rss_enclosure' ELSE '' END AS source, err AS error
FROM (SELECT b.*, CASE WHEN f.rss_url = '' THEN 'No RSS feed found for: ' || b.podcast_name WHEN CAST(substring(f.id, 4, 9) AS INT) % 6 = 1 THEN 'Failed to fetch RSS: ' || f.rss_url
  WHEN e.audio_url = '' THEN 'No matching episode found' ELSE '' END AS err FROM best b JOIN feeds f ON f.name = b.podcast_name JOIN episodes e ON e.item_pos = b.item_pos) b JOIN episodes e USING (item_pos)""", _MATCH, FEEDS))
def resolve_audio(spark, sf):
    feeds = feed_config(spark, sf).select(F.col("name").alias("podcast_name"), "rss_url", (F.substring("id", 4, 9).cast("int") % 6 != 1).alias("has_body"))
    return joins.resolve_audio(match_requests(spark, sf), feeds, match_items(spark, sf))


@query("expand_alias", """
WITH n AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'ha' ELSE 'reti' END AS name FROM documents)
SELECT doc_id, name, CASE WHEN name = 'the' AND contains(lower(text), 'thead') THEN 'thead' WHEN name = 'reti' AND contains(lower(text), 'haing') THEN 'haing' ELSE name END AS resolved_name FROM n""")
def expand_alias(spark, sf):
    mode = F.col("doc_id") % 3
    names = table(spark, sf, "documents").select("doc_id", "text", F.when(mode == 0, "the").when(mode == 1, "ha").otherwise("reti").alias("name"))
    aliases = spark.createDataFrame([("the", "thead"), ("reti", "haing")], "short string, full string")
    return joins.expand_alias(names, aliases).select("doc_id", "name", "resolved_name")


@query("update_queue_status", f"""
WITH {QUEUE.strip()} SELECT selection_id, CASE WHEN o_orderkey % 4 = 0 AND status = 'queued' THEN 'done' ELSE status END AS status,
  CASE WHEN o_orderkey % 4 = 0 AND status = 'queued' THEN 'doc' || o_orderkey END AS doc_id FROM queue""")
def update_queue_status(spark, sf):
    queue = queue_table(spark, sf)
    key = F.substring("selection_id", 5, 20).cast("bigint")
    updates = queue.filter((key % 4 == 0) & (F.col("status") == "queued")).select(
        "selection_id", F.lit("done").alias("status"), F.concat(F.lit("doc"), key.cast("string")).alias("doc_id"), F.lit("").alias("doc_url"), F.lit("").alias("finished_at"))
    return joins.update_queue_status(queue, updates).select("selection_id", "status", "doc_id")


@query("update_processing_status", with_lite("""
SELECT episode_id, CASE WHEN item_pos % 7 = 0 THEN 'full' ELSE 'preview' END AS selected_action, CASE WHEN item_pos % 7 = 0 THEN 'done' ELSE 'queued' END AS queue_status,
  'old' || item_pos AS preview_doc_url, CASE WHEN item_pos % 7 = 0 THEN 'new' || item_pos END AS full_doc_url FROM lite"""))
def update_processing_status(spark, sf):
    rows = lite_decisions(spark, sf)
    pos = F.col("item_pos").cast("string")
    none = F.lit(None).cast("string")
    old = F.struct(F.lit("preview").alias("selected_action"), F.lit("queued").alias("queue_status"), F.concat(F.lit("old"), pos).alias("preview_doc_url"),
                   none.alias("full_doc_url"), none.alias("last_processed_at"))
    registry = rows.select("episode_id", old.alias("processing_status"))
    updates = rows.filter(F.col("item_pos") % 7 == 0).select(
        "episode_id", F.lit("full").alias("selected_action"), F.lit("done").alias("queue_status"), F.lit("").alias("preview_doc_url"),
        F.concat(F.lit("new"), pos).alias("full_doc_url"), F.lit("").alias("last_processed_at"))
    unknown = updates.withColumn("episode_id", F.concat(F.lit("unknown_"), F.col("episode_id")))
    out = joins.update_processing_status(registry, updates.unionByName(unknown))
    return out.select("episode_id", *[F.col(f"processing_status.{c}").alias(c) for c in ("selected_action", "queue_status", "preview_doc_url", "full_doc_url")])


@query("reusable_artifacts", """
SELECT doc_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = documents.text AND d.lang = documents.lang AND d.doc_id % 4 = 0 AND d.doc_id % 3 <> 0) AS reusable FROM documents""")
def reusable_artifacts(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.lit(1).alias("schema_version"), F.sha2("text", 256).alias("source_sha256"), F.lit("mlx").alias("backend"), F.lit("large").alias("model"),
        F.col("lang").alias("language_requested"))
    done = docs.filter(F.col("doc_id") % 4 == 0).withColumns({
        "status": F.lit("success"), "txt_bytes": F.lit(10), "srt_bytes": (F.col("doc_id") % 3).cast("int"), "vtt_bytes": F.lit(5)})
    return joins.reusable_artifacts(docs, done).select("doc_id", "reusable")


@query("notified_consistently", """
SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 5 NOT IN (1, 2) AS consistent FROM orders""")
def notified_consistently(spark, sf):
    orders = table(spark, sf, "orders")
    run = F.concat(F.lit("run_"), F.col("o_orderkey").cast("string"))
    doc = F.col("o_custkey").cast("string")
    sent = orders.select(run.alias("run_id"), F.lit("w1").alias("week_id"), doc.alias("doc_id"), F.lit("u").alias("doc_url"))
    told = orders.select("o_orderkey", run.alias("run_id"), F.when(F.col("o_orderkey") % 5 == 1, "w2").otherwise("w1").alias("week_id"),
                         F.when(F.col("o_orderkey") % 5 == 2, "other").otherwise(doc).alias("doc_id"), F.lit("u").alias("doc_url"),
                         F.when(F.col("o_orderstatus") == "F", "success").otherwise("error").alias("notification_status"))
    return joins.notified_consistently(told, sent).select("o_orderkey", "consistent")
