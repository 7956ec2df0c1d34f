"""Queries on streams; each drains a stream over the given events and reads the stored result."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.plans.adapters import table
from feedsieve.plans.catalog import query
from feedsieve.session import new_folder
from feedsieve.streaming import stream as st

DELAY = "1 day"
_WEEK = "make_timestamp((CAST(floor(epoch(ts)) AS BIGINT) - ((CAST(floor(epoch(ts)) AS BIGINT) - 309600) % 604800)) * 1000000)"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return st.read_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_week_counts", f"""
SELECT isoyear(w + INTERVAL 10 HOURS) || 'W' || lpad(week(w + INTERVAL 10 HOURS)::VARCHAR, 2, '0') AS week_id, event_type, count(*) AS n FROM (SELECT *, {_WEEK} AS w FROM events)
WHERE w + INTERVAL 7 DAYS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY w, event_type""")
def stream_week_counts(spark, sf):
    counts = st.week_counts(event_stream(spark, sf), "ts", ["event_type"], DELAY)
    path = st.drain_to_table(counts, "week-counts")
    return spark.read.schema(counts.schema).parquet(path).select("week_id", "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    # The delay spans the whole month, so a key stays known throughout.
    once = st.first_seen(event_stream(spark, sf), "ts", ["user_id", "event_type"], "40 days").select("user_id", "event_type", "event_id")
    path = st.drain_to_table(once, "first-seen")
    return spark.read.schema(once.schema).parquet(path).select("user_id", "event_type")


@query("stream_registry", """
SELECT user_id::VARCHAR AS episode_id, count(*) AS seen_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, arg_max(event_type, event_id) AS decision FROM events GROUP BY user_id""")
def stream_registry(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision"))
    landed = new_folder(spark, "landed-events")
    events.write.option("maxRecordsPerFile", 20_000).parquet(landed)
    root = new_folder(spark, "registry")
    share = st.files_per_batch(spark, landed, events.schema, least=2)
    st.stream_registry(st.read_stream(spark, landed, events.schema, files_per_batch=share), root)
    shape = "yyyy-MM-dd HH:mm:ss"
    return st.read_registry(spark, root).select(
        "episode_id", "seen_count", F.date_format("first_seen", shape).alias("first_seen"), F.date_format("last_seen", shape).alias("last_seen"), "decision")


@query("stream_dedup_first", """
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id) = 1
  AND CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAYS FROM events)""")
def stream_dedup_first(spark, sf):
    """The best event of each user, type and day, from files that land in another order than that of the events."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", (-F.col("value")).alias("place"))
    landed = new_folder(spark, "landed-events")
    # Six files; the events of one day lie in several of them, in no order. All arrive within the delay of two days.
    events.repartitionByRange(6, "ts").sortWithinPartitions(F.xxhash64("event_id")).write.parquet(landed)
    stream = st.read_stream(spark, landed, events.schema, files_per_batch=6)
    once = st.first_by_order(stream, "ts", ["user_id", "event_type"], ["place", "event_id"], "2 days")
    path = st.drain_to_table(once, "first-by-order")
    return spark.read.schema(once.schema).parquet(path).select("user_id", "event_type", "event_id")
