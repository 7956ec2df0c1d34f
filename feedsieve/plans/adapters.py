"""Views of the given tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.functions import when
from feedsieve.policy import Interests, Policy
from feedsieve.session import spread

# Keywords that occur in the test prose; lists are parameters of every operator.
TEST_POLICY = Policy(
    full_threshold=60, preview_threshold=35, weekly_full_limit=5, weekly_preview_limit=15,
    ad_words=("copyright", "license"),
    action_words=("the", "that", "was", "on", "in", "der", "die", "et", "el", "of the", "haing"),
    strategic_words=("of", "to", "is", "as", "und", "von", "le", "de", "que", "los", "haea", "to the", "AI"),
    interests=Interests(
        boost=("The", "of", "and", "la", "der", "haing", "edon", "enti", "on the"), negative=("haea", "reti", "nder"),
        topics=("that", "les", "die", "ing"), people=("haing", "Edon")),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table of whole texts, dealt to all tasks before the texts are worked on."""
    return spread(table(spark, sf, name), key)


def _publish_second() -> Column:
    return F.lit(1704067200) + (F.col("doc_id") * 7919 % 43200) * 60


def episodes(spark: SparkSession, sf: str, with_texts: bool = True, dealt: bool = True) -> DataFrame:
    """`documents` as published items, their texts dealt to all tasks; without texts only the columns derived from ids and counts are read."""
    at = F.timestamp_seconds(_publish_second())
    start = when.week_start(F.col("pub_ts"))
    cols = [
        F.col("doc_id").alias("item_pos"), F.substring("source", 4, 9).cast("int").alias("feed_ord"), F.col("source").alias("podcast_id"),
        F.concat(F.lit("Show "), F.col("source")).alias("podcast_name"), F.col("lang").alias("language"),
        (F.col("n_chars") * 3 % 7200).cast("int").alias("duration_seconds"),
        F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.concat(F.lit("http://audio.test/"), F.col("doc_id").cast("string"), F.lit(".mp3"))).alias("audio_url"),
        at.alias("pub_ts"),
    ]
    if with_texts:
        cols += [F.substring("text", 1, 60).alias("episode_title"), F.col("text").alias("show_notes")]
    base = table(spark, sf, "documents").select(*cols)
    if with_texts and dealt:
        base = spread(base, "item_pos")
    base = base.withColumn("duration_minutes", F.floor(F.col("duration_seconds") / 60).cast("int"))
    dated = base.withColumns({
        "publish_date": F.date_format("pub_ts", "yyyy-MM-dd"), "pub_datetime": F.date_format("pub_ts", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "week_start": start})
    return dated.withColumn("week_id", when.week_id(F.col("week_start"))).withColumn("run_id", F.concat(F.lit("run_"), F.col("week_id")))


EPISODES = """
episodes AS (
  SELECT item_pos, feed_ord, podcast_id, podcast_name, language, duration_seconds, audio_url, pub_ts, episode_title, show_notes,
         duration_seconds // 60 AS duration_minutes, strftime(pub_ts, '%Y-%m-%d') AS publish_date,
         strftime(pub_ts, '%Y-%m-%dT%H:%M:%SZ') AS pub_datetime, make_timestamp(ws * 1000000) AS week_start,
         isoyear(make_timestamp((ws + 36000) * 1000000)) || 'W' || lpad(week(make_timestamp((ws + 36000) * 1000000))::VARCHAR, 2, '0') AS week_id,
         'run_' || isoyear(make_timestamp((ws + 36000) * 1000000)) || 'W' || lpad(week(make_timestamp((ws + 36000) * 1000000))::VARCHAR, 2, '0') AS run_id
  FROM (
    SELECT doc_id AS item_pos, CAST(substring(source, 4, 9) AS INT) AS feed_ord, source AS podcast_id, 'Show ' || source AS podcast_name,
           lang AS language, CAST((n_chars * 3) % 7200 AS INT) AS duration_seconds,
           CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'http://audio.test/' || doc_id || '.mp3' END AS audio_url,
           make_timestamp(s * 1000000) AS pub_ts, s - ((s - 309600) % 604800) AS ws, substring(text, 1, 60) AS episode_title, text AS show_notes
    FROM (SELECT *, 1704067200 + (doc_id * 7919 % 43200) * 60 AS s FROM documents)))
"""


def with_episodes(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((EPISODES.strip(), *[c.strip() for c in ctes])) + "\n" + query.strip()


def lite_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Items with a score and decision derived from ids and counts only (no text scan), for the relational operators."""
    eps = episodes(spark, sf, with_texts=False)
    score = (F.col("item_pos") * 37 % 1001) / 10.0
    mode = F.col("item_pos") % 10
    return eps.withColumns({
        "final_score": score, "decision": F.when(mode == 0, "full").when(mode < 7, "preview").otherwise("skip"),
        "episode_id": F.concat(F.col("podcast_id"), F.lit("_"), F.col("item_pos").cast("string"))})


LITE = """
lite AS (
  SELECT *, (item_pos * 37 % 1001) / 10e0 AS final_score,
         CASE WHEN item_pos % 10 = 0 THEN 'full' WHEN item_pos % 10 < 7 THEN 'preview' ELSE 'skip' END AS decision,
         podcast_id || '_' || item_pos AS episode_id
  FROM episodes)
"""


def with_lite(query: str, *ctes: str) -> str:
    return with_episodes(query, LITE, *ctes)


def feed_config(spark: SparkSession, sf: str) -> DataFrame:
    """Feed registry from the distinct sources: some without address, some without language."""
    src = table(spark, sf, "documents").select("source").distinct()
    n = F.substring("source", 4, 9).cast("int")
    return src.select(
        F.col("source").alias("id"), F.concat(F.lit("Show "), F.col("source")).alias("name"),
        F.when(n % 7 == 3, "").otherwise(F.concat(F.lit("http://feeds.test/"), F.col("source"))).alias("rss_url"),
        F.when(n % 5 == 4, "html_jsonld").otherwise("rss").alias("feed_type"), F.when(n % 2 == 0, "en").otherwise("zh").alias("language"))


FEEDS = """
feeds AS (
  SELECT source AS id, 'Show ' || source AS name, CASE WHEN n % 7 = 3 THEN '' ELSE 'http://feeds.test/' || source END AS rss_url,
         CASE WHEN n % 5 = 4 THEN 'html_jsonld' ELSE 'rss' END AS feed_type, CASE WHEN n % 2 = 0 THEN 'en' ELSE 'zh' END AS language
  FROM (SELECT DISTINCT source, CAST(substring(source, 4, 9) AS INT) AS n FROM documents))
"""


def landed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` written as feed bodies: RSS, or pages with an ld+json script, of at most twenty items each."""
    eps = episodes(spark, sf, dealt=False)
    stamp = F.date_format("pub_ts", "dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item><title><![CDATA["), F.replace("episode_title", F.lit("\n"), F.lit(" ")), F.lit("]]></title><pubDate>Mon, "), stamp,
        F.lit(" GMT</pubDate><itunes:duration>"), F.col("duration_seconds").cast("string"), F.lit("</itunes:duration><description><![CDATA[<p>"),
        F.col("show_notes"), F.lit("</p>]]></description><itunes:summary>"), F.left("show_notes", F.lit(100)), F.lit("</itunes:summary>"),
        F.when(F.col("audio_url") != "", F.concat(F.lit('<enclosure url="'), F.col("audio_url"), F.lit('" type="audio/mpeg"/>'))).otherwise(""),
        F.lit("<guid>"), F.col("item_pos").cast("string"), F.lit("</guid></item>"))
    entry = F.struct(
        F.replace("episode_title", F.lit("\n"), F.lit(" ")).alias("name"), F.date_format("pub_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datePublished"),
        F.col("duration_seconds").cast("string").alias("duration"), F.concat(F.lit("<p>"), F.col("show_notes"), F.lit("</p>")).alias("description"),
        F.array(F.struct(F.col("audio_url").alias("url"))).alias("offers"))
    is_page = F.col("feed_ord") % 5 == 4
    # A body is a page of one feed: twenty consecutive turns of the 20 sources at most.
    rows = eps.select("podcast_name", F.when(is_page, "html_jsonld").otherwise("rss").alias("feed_type"), F.floor(F.col("item_pos") / 400).alias("page_no"),
                      F.struct("item_pos", F.when(~is_page, item).alias("item"), F.when(is_page, entry).alias("entry")).alias("r"))
    ordered = F.sort_array(F.collect_list("r"))
    grouped = rows.groupBy("podcast_name", "feed_type", "page_no").agg(ordered.alias("rs"))
    rss = F.concat(F.lit("<rss><channel>"), F.array_join("rs.item", "\n"), F.lit("</channel></rss>"))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(F.struct(F.col("rs.entry").alias("workExample"))), F.lit("</script></html>"))
    return grouped.select("podcast_name", "feed_type", "page_no", F.when(F.col("feed_type") == "rss", rss).otherwise(page).alias("body"))


def run_heads(decisions: DataFrame) -> DataFrame:
    """One row per run with its counts, for the report operators."""
    counts = decisions.groupBy("run_id", "week_id").agg(
        F.min("week_start").alias("ws"), F.count("*").alias("total"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("full", "preview", "skip")])
    return counts.select(
        "run_id", "week_id", F.date_format("ws", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("window_start"),
        F.date_format(F.col("ws") + F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("window_end"), F.lit("2024-02-05").alias("scan_date"),
        "total", "full", "preview", "skip", F.lit(20).cast("bigint").alias("podcast_count"), F.lit(0).cast("bigint").alias("error_count"))


HEADS = """
heads AS (
  SELECT run_id, week_id, strftime(min(week_start), '%Y-%m-%dT%H:%M:%SZ') AS window_start,
         strftime(min(week_start) + INTERVAL 7 DAYS, '%Y-%m-%dT%H:%M:%SZ') AS window_end, count(*) AS total,
         count(*) FILTER (decision = 'full') AS n_full, count(*) FILTER (decision = 'preview') AS n_preview, count(*) FILTER (decision = 'skip') AS n_skip
  FROM lite GROUP BY run_id, week_id)
"""


def with_heads(query: str, *ctes: str) -> str:
    return with_lite(query, HEADS, *ctes)
