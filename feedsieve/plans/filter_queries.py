"""Queries for filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.functions import items as it
from feedsieve.functions import keywords as kw
from feedsieve.operators import background, delivery, guests, joins, translate
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import episodes, lite_decisions, table, with_episodes, with_lite
from feedsieve.plans.catalog import query

START, END = "2024-01-14 14:00:00", "2024-01-21 14:00:00"


@query("week_filter", with_episodes(f"""
SELECT item_pos FROM episodes WHERE CASE item_pos % 10 WHEN 7 THEN false WHEN 8 THEN publish_date >= '2024-01-14' AND publish_date < '2024-01-21' WHEN 9 THEN false
  ELSE pub_ts >= TIMESTAMP '{START}' AND pub_ts < TIMESTAMP '{END}' END"""))
def week_filter(spark, sf):
    mode = F.col("item_pos") % 10
    rfc = F.concat(F.lit("Sun, "), F.date_format("pub_ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    eps = episodes(spark, sf, with_texts=False).withColumns({
        "pub_datetime": F.when(mode == 7, "soon").when(mode.isin(8, 9), "").when(mode < 3, rfc).otherwise(F.col("pub_datetime")),
        "publish_date": F.when(mode == 9, "").otherwise(F.col("publish_date"))})
    return joins.week_filter(eps, F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp")).select("item_pos")


WORDS = ("the", "haing", "AI", "of the", "edon", "und", "la", "reti")


@query("keyword_match", f"SELECT doc_id, {', '.join(f'{q.kw('low', w)} AS k{i}' for i, w in enumerate(WORDS))} FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def keyword_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[kw.keyword_match(F.col("text"), w).alias(f"k{i}") for i, w in enumerate(WORDS)])


_A, _B, _C = it.FALLBACKS


@query("fallback_text", "SELECT doc_id, doc_id % 7 IN (0, 1, 2, 4) AS is_fallback FROM documents")
def fallback_text(spark, sf):
    mode, head = F.col("doc_id") % 7, F.col("text")
    shown = (F.when(mode == 0, "").when(mode == 1, _A).when(mode == 2, f"{_A}；{_B}").when(mode == 3, F.concat(F.lit(_A + "；"), F.col("text")))
             .when(mode == 4, _C).when(mode == 5, f"{_B}；{_C}").otherwise(head))
    return table(spark, sf, "documents").select("doc_id", it.is_fallback(shown).alias("is_fallback"))


@query("source_noise", "SELECT page_id, page_id % 6 IN (0, 1, 2, 4) AS is_noise FROM pages")
def source_noise(spark, sf):
    mode = F.col("page_id") % 6
    snippet = (F.when(mode == 0, "").when(mode == 1, "职务/头衔：Author, writer").when(mode == 2, F.concat(F.lit("On Venture Capital at "), F.col("url")))
               .when(mode == 3, F.concat(F.lit("职务/头衔：writer | "), F.col("url"))).when(mode == 4, " ; / ").otherwise(F.col("url")))
    return table(spark, sf, "pages").select("page_id", it.is_source_noise(snippet).alias("is_noise"))




@query("name_noise", "SELECT c_custkey, c_custkey % 9 <= 6 AS is_noise, c_custkey % 9 = 7 AS is_sponsor FROM customer")
def name_noise(spark, sf):
    key, mode = F.col("c_custkey").cast("string"), F.col("c_custkey") % 9
    name = (F.when(mode == 0, "x").when(mode == 1, F.concat(F.lit("Episode "), key)).when(mode == 2, F.concat(key, F.lit(" / 7")))
            .when(mode == 3, F.concat(F.lit("12:30 "), F.col("c_name"))).when(mode == 4, "the of").when(mode == 5, "Subscribe")
            .when(mode == 6, F.repeat(F.lit("na"), 31)).when(mode == 7, "promo code rogan").otherwise(F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", guests.name_noise(name).alias("is_noise"), guests.known_noise(name).alias("is_sponsor"))


@query("title_entity", "SELECT n_nationkey, lower(trim(n_name)) IN ('france', 'peru', 'china') AS is_entity FROM nation")
def title_entity(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", guests.title_entity(F.col("n_name"), ("france", "peru", "china")).alias("is_entity"))


@query("safe_org", """SELECT p_partkey, p_partkey % 6 = 5 AS is_safe FROM part""")
def safe_org(spark, sf):
    mode = F.col("p_partkey") % 6
    org = (F.when(mode == 0, "Capital.").when(mode == 1, F.concat(F.lit("of "), F.col("p_name"))).when(mode == 2, F.concat(F.lit("Private Markets "), F.col("p_brand")))
           .when(mode == 3, F.col("p_partkey").cast("string")).when(mode == 4, F.repeat(F.lit("long name "), 9)).otherwise(F.concat(F.col("p_brand"), F.lit(" Labs"))))
    return table(spark, sf, "part").select("p_partkey", background.safe_org(org).alias("is_safe"))


@query("required_fields", with_lite("""
SELECT DISTINCT run_id, CASE WHEN right(week_id, 1) IN ('1', '3') THEN 'window_end' ELSE '' END AS missing, right(week_id, 1) NOT IN ('1', '3') AS is_valid FROM lite"""))
def required_fields(spark, sf):
    runs = lite_decisions(spark, sf).select("run_id", "week_id").distinct()
    runs = runs.withColumns({"window_start": F.lit("a"), "window_end": F.when(F.right("week_id", F.lit(1)).isin("1", "3"), "").otherwise("b")})
    return delivery.required_fields(runs).select("run_id", F.array_join("missing", ",").alias("missing"), "is_valid")


@query("delivery_action", """
SELECT o_orderkey, CASE WHEN d AND NOT f THEN 'skip' WHEN d THEN 'force-create' WHEN m AND NOT f THEN 'requires-force' ELSE 'create' END AS deliver,
  CASE WHEN n AND NOT f THEN 'skip' WHEN n THEN 'force-send' WHEN NOT d THEN 'requires-delivery' WHEN nm AND NOT f THEN 'requires-force' ELSE 'send' END AS notify
FROM (SELECT o_orderkey, o_orderstatus = 'F' AND o_custkey % 3 <> 0 AS d, o_orderstatus <> 'O' AS m, o_custkey % 5 = 0 AS f, o_orderkey % 4 = 0 AS n, o_orderkey % 2 = 0 AS nm FROM orders)""")
def delivery_action(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    done = delivery.delivered(F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "error"),
                              F.when(cust % 3 != 0, cust.cast("string")), F.lit("url"))
    meta, force = F.col("o_orderstatus") != "O", cust % 5 == 0
    return table(spark, sf, "orders").select(
        "o_orderkey", delivery.delivery_action(done, meta, force).alias("deliver"), delivery.notify_action(key % 4 == 0, done, key % 2 == 0, force).alias("notify"))


def queue_table(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("sel_"), F.col("o_orderkey").cast("string")).alias("selection_id"), F.col("o_custkey").cast("string").alias("episode_id"),
        F.when(status == "O", "queued").when(status == "P", "error").otherwise("done").alias("status"), F.lit(None).cast("string").alias("doc_id"),
        F.lit("").alias("doc_url"), F.lit(None).cast("string").alias("finished_at"), F.col("o_orderdate").cast("timestamp").alias("published_at"))


QUEUE = """
queue AS (SELECT 'sel_' || o_orderkey AS selection_id, o_custkey::VARCHAR AS episode_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'error' ELSE 'done' END AS status,
  o_orderkey, o_custkey, o_orderdate AS published_at FROM orders)"""


@query("queued_items", f"WITH {QUEUE.strip()} SELECT selection_id, episode_id FROM queue WHERE status = 'queued'")
def queued_items(spark, sf):
    return delivery.queued_items(queue_table(spark, sf)).select("selection_id", "episode_id")


@query("accept_generated_text", f"""
SELECT conv_id, turn, length({q.strip('t')}) >= 20 AND NOT contains(t, '信息不足') AS accepted
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN text ELSE text || '信息不足' END AS t FROM conversations)""")
def accept_generated_text(spark, sf):
    mode = F.col("turn") % 3
    shown = F.when(mode < 2, F.col("text")).otherwise(F.concat("text", F.lit("信息不足")))
    return table(spark, sf, "conversations").select("conv_id", "turn", it.accept_generated(shown).alias("accepted"))


@query("valid_partial_cache", """
SELECT doc_id, doc_id % 8 = 1 AS is_valid FROM documents""")
def valid_partial_cache(spark, sf):
    mode = F.col("doc_id") % 8
    spots = F.when(mode == 2, F.array(F.lit(1), F.lit(1))).when(mode == 3, F.array(F.lit(9))).when(mode == 4, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    error = F.struct(F.when(mode == 5, 0).otherwise(1).alias("chunk_index"), (mode != 6).alias("localized_fallback"))
    entry = table(spark, sf, "documents").select(
        "doc_id", F.when(mode == 0, "ok").otherwise("partial_ok").alias("status"), F.concat("text", F.lit("\n延伸阅读（原文）：\nx")).alias("translated_text"),
        F.lit(3).alias("chunk_count"), F.when(mode == 7, 3).otherwise(2).alias("translated_chunk_count"), spots.alias("localized_fallback_chunk_indices"), F.array(error).alias("errors"))
    return entry.select("doc_id", translate.valid_partial().alias("is_valid"))
