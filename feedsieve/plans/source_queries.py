"""Queries for reading landed bodies, state files and binaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve import schemas
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import episodes, feed_config, FEEDS, landed_bodies, lite_decisions, table, with_episodes, with_lite
from feedsieve.plans.catalog import query
from feedsieve.session import new_folder
from feedsieve.sources import feeds, runs


@query("scan_feed_registry", f"WITH {FEEDS.strip()} SELECT * FROM feeds WHERE rss_url <> ''")
def scan_feed_registry(spark, sf):
    return feeds.scan_feed_registry(feed_config(spark, sf))


_ITEM_COLUMNS = ("podcast_name", "episode_title", "publish_date", "pub_datetime", "duration_seconds", "duration_minutes", "audio_url", "show_notes",
                 "show_notes_source", "show_notes_text_len", "show_notes_truncated", "rss_description_len", "rss_itunes_summary_len")


def _items_sql(where: str, iso: str, summary: str) -> str:
    return with_episodes(f"""
SELECT podcast_name, {q.strip("replace(episode_title, chr(10), ' ')") if "%z" in iso else "replace(episode_title, chr(10), ' ')"} AS episode_title, publish_date, {iso.replace('%z', '')} AS pub_datetime,
  CAST(duration_seconds AS BIGINT) AS duration_seconds, CAST(duration_minutes AS BIGINT) AS duration_minutes, audio_url, left(pick, 5000) AS show_notes,
  CASE WHEN length(c0) >= length(c2) OR (greatest(length(c0), length(c2)) < 20) THEN 'description' ELSE 'itunes_summary' END AS show_notes_source,
  CAST(least(length(pick), 5000) AS INT) AS show_notes_text_len, length(pick) > 5000 AS show_notes_truncated, CAST(length(c0) AS INT) AS rss_description_len, CAST(length(c2) AS INT) AS rss_itunes_summary_len
FROM (SELECT *, CASE WHEN length(c0) >= length(c2) OR greatest(length(c0), length(c2)) < 20 THEN c0 ELSE c2 END AS pick
  FROM (SELECT *, {q.clean_html('show_notes')} AS c0, {summary} AS c2 FROM episodes WHERE {where}))""")


_RSS = _items_sql("feed_ord % 5 <> 4", "strftime(pub_ts, '%Y-%m-%dT%H:%M:%S') || '+0000%z'", q.clean_html("left(show_notes, 100)"))
_PAGE = _items_sql("feed_ord % 5 = 4", "strftime(pub_ts, '%Y-%m-%dT%H:%M:%S')", "''")


@query("scan_feed_items", _RSS)
def scan_feed_items(spark, sf):
    bodies = landed_bodies(spark, sf).filter(F.col("feed_type") == "rss")
    return feeds.scan_feed_items(bodies).select(*_ITEM_COLUMNS)


@query("scan_page_items", """
WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS item_no, regexp_extract(items[i], 'href="([^"]*)"', 1) AS href FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM m)""")
def scan_page_items(spark, sf):
    items = feeds.explode_items(table(spark, sf, "pages").select("page_id", "html"), "(?s)<li>(.*?)</li>", "html")
    return items.select("page_id", "item_no", F.regexp_extract("item", 'href="([^"]*)"', 1).alias("href"))


@query("scan_enclosure_items", with_episodes(f"""
SELECT podcast_name, {q.strip("replace(episode_title, chr(10), ' ')")} AS title, publish_date AS pub_date, audio_url AS enclosure_url, item_pos::VARCHAR AS guid FROM episodes WHERE feed_ord % 5 <> 4 AND audio_url <> ''"""))
def scan_enclosure_items(spark, sf):
    bodies = landed_bodies(spark, sf).filter(F.col("feed_type") == "rss")
    return feeds.scan_enclosure_items(bodies).select("podcast_name", "title", "pub_date", "enclosure_url", "guid")


@query("scan_jsonld_items", _PAGE)
def scan_jsonld_items(spark, sf):
    bodies = landed_bodies(spark, sf).filter(F.col("feed_type") == "html_jsonld")
    broken = bodies.withColumns({"podcast_name": F.concat(F.lit("broken "), F.col("podcast_name")), "body": F.replace("body", F.lit('{"workExample"'), F.lit('{workExample"'))})
    return feeds.scan_jsonld_items(bodies.unionByName(broken)).select(*_ITEM_COLUMNS)


@query("scan_feeds_by_type", f"SELECT * FROM ({_RSS}) UNION ALL SELECT * FROM ({_PAGE})")
def scan_feeds_by_type(spark, sf):
    return feeds.scan_feeds_by_type(landed_bodies(spark, sf)).select(*_ITEM_COLUMNS)


@query("feeds_without_content", f"""
WITH {FEEDS.strip()} SELECT id FROM feeds WHERE rss_url <> '' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = feeds.id AND d.doc_id % 20 % 6 <> 1)""")
def feeds_without_content(spark, sf):
    docs = table(spark, sf, "documents")
    # One sixth of the feeds landed empty.
    bodies = docs.select(F.concat(F.lit("Show "), F.col("source")).alias("podcast_name"), F.when(F.col("doc_id") % 20 % 6 == 1, "").otherwise(F.col("text")).alias("body"))
    return feeds.feeds_without_content(feed_config(spark, sf), bodies)


@query("scan_jsonl_state", "SELECT user_id::VARCHAR || ':' || event_id AS selection_id, event_type AS status FROM events WHERE event_id % 9 NOT IN (1, 2, 3)")
def scan_jsonl_state(spark, sf):
    good = F.to_json(F.struct(
        F.when(F.col("event_id") % 9 == 3, "").otherwise(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"))).alias("selection_id"),
        F.col("event_type").alias("status")))
    line = F.when(F.col("event_id") % 9 == 1, "").when(F.col("event_id") % 9 == 2, "{broken").otherwise(good)
    path = new_folder(spark, "jsonl-state")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return feeds.scan_jsonl_state(spark, path, schemas.QUEUE, "selection_id").select("selection_id", "status")


def _stored_runs(spark, sf):
    path = new_folder(spark, "runs")
    rows = lite_decisions(spark, sf).select("week_id", "run_id", "episode_id", "decision", "final_score", F.col("week_id").alias("started_for"))
    runs.write_run_result(rows, path, "started_for")
    return runs.read_runs(spark, path, "episode_id string, decision string, final_score double, week_id string, run_id string")


@query("scan_run_result", with_lite("SELECT episode_id, decision, final_score FROM lite WHERE run_id = (SELECT max(run_id) FROM lite)"))
def scan_run_result(spark, sf):
    return runs.scan_run_result(_stored_runs(spark, sf)).select("episode_id", "decision", "final_score")


@query("run_bucket_lookup", with_lite("SELECT run_id, decision, CAST(CASE decision WHEN 'full' THEN 0 WHEN 'preview' THEN 1 ELSE 2 END AS INT) AS bucket_order FROM lite WHERE episode_id = 'src3_43'"))
def run_bucket_lookup(spark, sf):
    return runs.run_bucket_lookup(lite_decisions(spark, sf), "src3_43").select("run_id", "decision", "bucket_order")


@query("scan_binary_digests")
def scan_binary_digests(spark, sf):
    return feeds.scan_binary_digests(spark, sf, "*.parquet")


# One body per document: whole, or broken in a way that its number tells.
_DAMAGE = "doc_id % 7"


def damaged_bodies(spark, sf):
    d, item = F.col("doc_id") % 7, F.concat(F.lit("<item><title>T"), F.col("doc_id").cast("string"), F.lit("</title><description>"), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("</description></item>"))
    page = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("name"))).alias("workExample"))), F.lit("</script>"))
    body = (F.when(d == 0, F.concat(F.lit("<rss>"), item, item, F.lit("</rss>"))).when(d == 1, "").when(d == 2, F.concat(F.lit("<rss>"), item, F.lit("<item><title>cut"))).when(d == 3, "<rss><channel></channel></rss>")
            .when(d == 4, page).when(d == 5, F.concat(F.left(page, F.lit(60)), F.lit("</script>"))).otherwise("<html>no script</html>"))
    return table(spark, sf, "documents").select(F.concat(F.lit("Show "), F.col("source")).alias("podcast_name"), F.when(d >= 4, "html_jsonld").otherwise("rss").alias("feed_type"), body.alias("body"))


@query("feed_errors", f"""
WITH {FEEDS.strip()},
d AS (SELECT 'Show ' || source AS name, [NULL, 'empty body', 'unfinished item', 'no items', NULL, 'broken data script', 'no data script'][{_DAMAGE} + 1] AS reason FROM documents WHERE source <> 'src1')
SELECT name, reason, count(*) AS bodies FROM d WHERE reason IS NOT NULL GROUP BY name, reason
UNION ALL SELECT name, 'nothing landed', 0 FROM feeds WHERE rss_url <> '' AND name NOT IN (SELECT name FROM d)""")
def feed_errors(spark, sf):
    bodies = damaged_bodies(spark, sf).where("podcast_name <> 'Show src1'")
    return feeds.feed_errors(feed_config(spark, sf), bodies)


@query("feed_items_beside_errors", f"""
SELECT 'Show ' || source AS podcast_name, sum(CASE {_DAMAGE} WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END)::BIGINT AS items FROM documents WHERE {_DAMAGE} IN (0, 2, 4) GROUP BY source""")
def feed_items_beside_errors(spark, sf):
    return feeds.scan_feeds_by_type(damaged_bodies(spark, sf)).groupBy("podcast_name").agg(F.count("*").alias("items"))


@query("landed_week", with_episodes("SELECT item_pos, podcast_id FROM episodes WHERE pub_ts >= TIMESTAMP '2024-01-07 14:00:00' AND pub_ts < TIMESTAMP '2024-01-14 14:00:00'"))
def landed_week(spark, sf):
    path = new_folder(spark, "landed-items")
    feeds.land_items(episodes(spark, sf, with_texts=False).select("item_pos", "podcast_id", "pub_ts"), path)
    landed = feeds.read_landed(spark, path, "item_pos bigint, podcast_id string, pub_ts timestamp")
    return feeds.landed_week(landed, *[F.lit(t).cast("timestamp") for t in ("2024-01-07 14:00:00", "2024-01-14 14:00:00")]).select("item_pos", "podcast_id")


@query("landed_in_runs", with_episodes("SELECT item_pos, 'run_' || week_id AS run_id FROM episodes WHERE isoyear(week_start + INTERVAL 10 HOURS) = 2024 AND week(week_start + INTERVAL 10 HOURS) % 2 = 0"))
def landed_in_runs(spark, sf):
    """Items of every second week's run."""
    path = new_folder(spark, "landed-items")
    eps = episodes(spark, sf, with_texts=False).select("item_pos", "pub_ts", "week_start", "week_id")
    feeds.land_items(eps.select("item_pos", "pub_ts"), path)
    runs_ = eps.where("weekofyear(week_start + INTERVAL 10 HOURS) % 2 = 0").select(
        F.concat(F.lit("run_"), "week_id").alias("run_id"), F.col("week_start").alias("window_start"), (F.col("week_start") + F.expr("INTERVAL 7 DAYS")).alias("window_end")).distinct()
    return feeds.landed_in_runs(feeds.read_landed(spark, path, "item_pos bigint, pub_ts timestamp"), runs_).select("item_pos", "run_id")
