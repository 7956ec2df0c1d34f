"""Queries for deduplication, history, priorities, limits, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.operators import guests, joins, quality, ranking
from feedsieve.plans.adapters import episodes, lite_decisions, table, TEST_POLICY, with_episodes, with_lite
from feedsieve.plans.catalog import query
from feedsieve.plans.weekly_queries import EPISODE_ID
from feedsieve.functions.items import episode_id


@query("dedup_episode_id", with_episodes(f"""
SELECT item_pos, podcast_id, episode_id FROM (SELECT *, {EPISODE_ID} AS episode_id FROM episodes) QUALIFY row_number() OVER (PARTITION BY podcast_id, episode_id ORDER BY item_pos) = 1"""))
def dedup_episode_id(spark, sf):
    named = episodes(spark, sf).withColumn("episode_id", episode_id(F.col("podcast_id"), F.col("publish_date"), F.col("episode_title")))
    return ranking.dedup_episode_id(named.select("item_pos", "podcast_id", "episode_id"))


@query("dedup_cross_feed", with_episodes("""
SELECT item_pos, feed_ord, episode_title FROM episodes QUALIFY row_number() OVER (PARTITION BY episode_title || left(publish_date, 7) ORDER BY feed_ord, item_pos) = 1"""))
def dedup_cross_feed(spark, sf):
    monthly = episodes(spark, sf).withColumn("publish_date", F.left("publish_date", F.lit(7)))
    return ranking.dedup_cross_feed(monthly).select("item_pos", "feed_ord", "episode_title")


@query("last_record_wins", """
SELECT user_id || ':' || event_type AS key, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def last_record_wins(spark, sf):
    rows = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "value")
    return ranking.last_record_wins(rows, "key", ["event_id"])


@query("decision_history", """
SELECT user_id AS episode_id, string_agg(event_type, ',' ORDER BY event_id) AS statuses FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 52) GROUP BY user_id""")
def decision_history(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision"))
    return ranking.decision_history(rows).select("episode_id", F.array_join("statuses", ",").alias("statuses"))


_CUTS = """
ranked AS (SELECT week_id, final_score, row_number() OVER (PARTITION BY week_id ORDER BY final_score DESC) AS rn, count(*) OVER (PARTITION BY week_id) AS n FROM lite WHERE decision = 'preview'),
cuts AS (SELECT week_id, max(n) AS n, max(CASE WHEN rn = greatest(0, CAST(floor(n * 2e-1) AS BIGINT) - 1) + 1 THEN final_score END) AS u,
  max(CASE WHEN rn = greatest(0, CAST(floor(n * 6e-1) AS BIGINT) - 1) + 1 THEN final_score END) AS l FROM ranked GROUP BY week_id)"""


@query("relative_priority", with_lite("""
SELECT item_pos, week_id, CASE WHEN decision <> 'preview' OR n < 2 THEN 'medium' WHEN final_score >= (CASE WHEN n >= 5 THEN u ELSE (u + l) / 2 END) THEN 'high'
  WHEN final_score >= l THEN 'medium' ELSE 'low' END AS priority FROM lite LEFT JOIN cuts USING (week_id)""", _CUTS))
def relative_priority(spark, sf):
    return ranking.relative_priority(lite_decisions(spark, sf)).select("item_pos", "week_id", "priority")


@query("weekly_limits", with_lite("""
SELECT item_pos, CASE WHEN decision = 'full' AND rn > 5 THEN 'preview' WHEN decision = 'preview' AND rn > 15 THEN 'skip' ELSE decision END AS decision,
  'r' || CASE WHEN decision = 'full' AND rn > 5 THEN '（超出周限，降级为preview）' WHEN decision = 'preview' AND rn > 15 THEN '（超出周限，降级为skip）' ELSE '' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY week_id, decision ORDER BY final_score DESC, feed_ord, item_pos) AS rn FROM lite)"""))
def weekly_limits(spark, sf):
    return ranking.weekly_limits(lite_decisions(spark, sf).withColumn("reason", F.lit("r")), TEST_POLICY).select("item_pos", "decision", "reason")


@query("guest_candidate_dedup", """
WITH c AS (SELECT o_orderkey // 50 AS item, o_orderkey AS seq, 'Guest ' || (o_custkey % 9) AS name,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed_guest' WHEN 'O' THEN 'possible_guest' ELSE 'mentioned_entity' END AS decision,
    CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 2 END AS p FROM orders)
SELECT item AS item_pos, name, decision FROM c QUALIFY row_number() OVER (PARTITION BY item, lower(name) ORDER BY p DESC, seq) = 1""")
def guest_candidate_dedup(spark, sf):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    decision = F.when(status == "F", "confirmed_guest").when(status == "O", "possible_guest").otherwise("mentioned_entity")
    rows = table(spark, sf, "orders").select(
        F.floor(key / 50).alias("item_pos"), F.lit(0).alias("pattern_no"), F.lit(0).alias("source_no"), key.cast("int").alias("match_no"),
        F.concat(F.lit("Guest "), (F.col("o_custkey") % 9).cast("string")).alias("name"), F.lit("description").alias("source"), F.lit("p").alias("pattern"),
        F.lit("m").alias("matched_text"), decision.alias("decision"), F.lit("").alias("reason"))
    return guests.dedup_candidates(rows).select("item_pos", "name", "decision")


@query("rank_by_score", with_lite("""
SELECT item_pos, final_score, row_number() OVER (ORDER BY final_score DESC, feed_ord, item_pos) AS place FROM lite"""))
def rank_by_score(spark, sf):
    return ranking.rank_by_score(lite_decisions(spark, sf).select("item_pos", "feed_ord", "final_score")).drop("feed_ord")


@query("top_recommendations", with_lite("""
SELECT week_id, item_pos, decision, final_score, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY week_id ORDER BY final_score DESC, decision, feed_ord, item_pos) AS place FROM lite WHERE decision <> 'skip') WHERE place <= 3"""))
def top_recommendations(spark, sf):
    return ranking.top_recommendations(lite_decisions(spark, sf)).select("week_id", "item_pos", "decision", "final_score", "place")


@query("bounded_lists", """
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (rn <= 2) AS first_two, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (rn <= 3) AS first_three,
  string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (rn <= 5) AS first_five, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (rn <= 8) AS first_eight
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY o_custkey""")
def bounded_lists(spark, sf):
    # Eight rows per key leave each map task at most; the lists are built from those.
    kept = ranking.top_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 8)
    keys = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return kept.groupBy("o_custkey").agg(keys.alias("k")).select(
        "o_custkey", *[F.array_join(F.slice("k", 1, n), ",").alias(name) for n, name in ((2, "first_two"), (3, "first_three"), (5, "first_five"), (8, "first_eight"))])


@query("union_decisions", with_lite("SELECT item_pos, decision, run_id FROM lite"))
def union_decisions(spark, sf):
    rows = lite_decisions(spark, sf)
    full, preview, skip = (rows.filter(F.col("decision") == d).select("item_pos", "run_id") for d in ("full", "preview", "skip"))
    return ranking.union_decisions(full, preview, skip)


@query("union_feeds", with_episodes("""
SELECT podcast_id, feed_ord, count(*) AS items, min(item_pos) AS first_pos, max(item_pos) AS last_pos, count(audio_url) AS with_audio FROM (
  SELECT podcast_id, 0 AS feed_ord, item_pos, audio_url FROM episodes UNION ALL SELECT 'page ' || page_id % 10, 1, page_id, NULL FROM pages) GROUP BY podcast_id, feed_ord"""))
def union_feeds(spark, sf):
    eps = episodes(spark, sf, with_texts=False).select("podcast_id", "item_pos", "audio_url")
    page = table(spark, sf, "pages").select(F.concat(F.lit("page "), (F.col("page_id") % 10).cast("string")).alias("podcast_id"), F.col("page_id").alias("item_pos"))
    return ranking.union_feeds(eps, page).groupBy("podcast_id", "feed_ord").agg(
        F.count("*").alias("items"), F.min("item_pos").alias("first_pos"), F.max("item_pos").alias("last_pos"), F.count("audio_url").alias("with_audio"))


@query("new_vs_known", with_lite("""
SELECT item_pos, NOT EXISTS (SELECT 1 FROM lite k WHERE k.episode_id = l.episode_id AND k.pub_ts < TIMESTAMP '2024-01-14 14:00:00') AS is_new FROM lite l"""))
def new_vs_known(spark, sf):
    rows = lite_decisions(spark, sf).select("item_pos", "episode_id", "pub_ts")
    registry = rows.filter(F.col("pub_ts") < F.lit("2024-01-14 14:00:00").cast("timestamp"))
    return joins.new_vs_known(rows, registry).select("item_pos", "is_new")


@query("duplicate_reasons", "SELECT text AS reason_zh, count(*) AS same_count FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_reasons(spark, sf):
    return quality.duplicate_reasons(table(spark, sf, "documents").select(F.col("text").alias("reason_zh")))
