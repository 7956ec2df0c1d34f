"""Queries for guest extraction and background."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.operators import background, guests
from feedsieve.operators.quality import source_quality
from feedsieve.plans.adapters import table, texts
from feedsieve.plans.catalog import query


def guest_items(spark, sf):
    """`documents` as items whose notes name somebody in one of several ways; the names are words of the text."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    docs = texts(spark, sf).select("doc_id", "text", "source", words.alias("w"))
    name = lambda i: F.initcap(F.concat_ws(" ", F.get("w", F.lit(i)), F.get("w", F.lit(i + 1))))
    named = docs.withColumns({"a": name(0), "b": name(4)})
    a, b, t = F.col("a"), F.col("b"), F.col("text")
    mode = F.col("doc_id") % 9
    notes = (
        F.when(mode == 0, F.concat(F.lit("Guest: "), a, F.lit(", founder of Acme Labs.\n"), t))
        .when(mode == 1, F.concat(a, F.lit(" is a writer and actor.\n"), t))
        .when(mode == 2, F.concat(F.lit("Our host speaks with "), a, F.lit(", CEO at Acme Works, and "), b, F.lit(", trader, about it.\n"), t))
        .when(mode == 3, F.concat(F.lit("本期嘉宾：张璐，专注新能源产业研究。\n"), t))
        .when(mode == 4, F.concat(F.lit("A show with "), a, F.lit(" today\n"), t))
        .when(mode == 5, F.concat(a, F.lit(", PhD, is Chief Scientist at the Institute of Notes.\n"), t))
        .when(mode == 6, F.concat(a, F.lit(" and "), b, F.lit(" discuss markets.\n"), t)).otherwise(t))
    title = F.when(mode == 7, F.concat(F.col("doc_id").cast("string"), F.lit(". 对何小鹏的第二次访谈"))).otherwise(F.concat(F.lit("Item "), F.col("doc_id").cast("string")))
    return named.select(F.col("doc_id").alias("item_pos"), F.concat(F.lit("Show "), F.col("source")).alias("podcast_name"), title.alias("episode_title"),
                        notes.alias("show_notes"), "a", "b")


def guest_hosts(spark, sf):
    return spark.createDataFrame([("Show src1", "Acme Host"), ("Show src2", "张璐")], "podcast_name string, host string")


def alias_table(spark):
    return spark.createDataFrame(list(guests.ALIASES), "short string, full string")


def candidates(spark, sf):
    return guests.guest_candidates(guest_items(spark, sf), guest_hosts(spark, sf), alias_table(spark))


@query("guest_candidates")
def guest_candidates(spark, sf):
    return candidates(spark, sf).select("item_pos", "pattern_no", "source_no", "match_no", "name", "source", "pattern", "matched_text", "decision", "reason")


@query("union_candidates")
def union_candidates(spark, sf):
    return guests.raw_candidates(guest_items(spark, sf)).groupBy("source", "pattern").agg(F.count("*").alias("n"))


def statuses(spark, sf):
    found = guests.dedup_candidates(candidates(spark, sf))
    return guests.guest_status(guest_items(spark, sf), found, guest_hosts(spark, sf))


@query("guest_detection")
def guest_detection(spark, sf):
    return statuses(spark, sf).select("item_pos", "guest_detection_status", F.array_join("guest_names", "|").alias("guest_names"), F.size("guest_detection_evidence").alias("n_evidence"),
                                      guests.evidence_text(F.col("guest_detection_evidence")).alias("evidence"))


@query("clean_guest_name", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Customer ' || c_custkey WHEN 2 THEN 'Bo Chan' WHEN 3 THEN 'Cy Dee' WHEN 4 THEN '张璐' ELSE c_name END AS name FROM customer""")
def clean_guest_name(spark, sf):
    key, mode = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    raw = (F.when(mode == 0, F.concat(F.lit("economist  Ann Lee and "), F.col("c_name"))).when(mode == 1, F.concat(F.lit("'Customer "), key, F.lit("\".,")))
           .when(mode == 2, "Substack writer Bo Chan").when(mode == 3, F.concat(F.lit("Cy Dee about "), F.col("c_mktsegment"))).when(mode == 4, "安克创新的创始人张璐").otherwise(F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", guests.clean_guest_name(raw).alias("name"))


@query("split_multi_guest", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee|Bo Chan of' ELSE 'Ann Lee' END AS names FROM customer""")
def split_multi_guest(spark, sf):
    mode = F.col("c_custkey") % 3
    matched = F.when(mode == 0, F.concat(F.lit("talks with Ann Lee and Bo Chan of "), F.col("c_name"))).when(mode == 1, F.concat(F.lit("talks with Ann Lee, "), F.col("c_name"))).otherwise("with Ann Lee and the of")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(guests.split_multi_guest(matched, F.lit("Ann Lee")), "|").alias("names"))


@query("guest_status", """
WITH c AS (SELECT o_orderkey // 4 AS item, 'Guest ' || o_orderkey AS name, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'c' WHEN 'O' THEN 'p' ELSE 'm' END AS d FROM orders WHERE o_orderkey % 4 < 1 + (o_orderkey // 4) % 4),
g AS (SELECT item, count(*) FILTER (d = 'c') AS c, count(*) FILTER (d = 'p') AS p, count(*) FILTER (d = 'm') AS m, list(name ORDER BY k) AS names, list(name ORDER BY k) FILTER (d = 'c') AS cn,
  list(name ORDER BY k) FILTER (d = 'p') AS pn, list(name ORDER BY k) FILTER (d = 'm') AS mn FROM c GROUP BY item)
SELECT i.item, CASE WHEN g.item IS NULL THEN 'no_guest_detected' WHEN c = 1 THEN 'confirmed_guest' WHEN c > 1 THEN 'ambiguous' WHEN p = 1 AND m = 0 THEN 'possible_guest' WHEN m = 1 AND p = 0 THEN 'mentioned_entity' ELSE 'ambiguous' END AS status,
  CASE WHEN g.item IS NULL THEN '' WHEN c >= 1 THEN array_to_string(cn, '|') WHEN p = 1 AND m = 0 THEN pn[1] WHEN m = 1 AND p = 0 THEN mn[1] ELSE array_to_string(names[1:3], '|') END AS names
FROM (SELECT DISTINCT o_orderkey // 4 AS item FROM orders) i LEFT JOIN g USING (item)""")
def guest_status(spark, sf):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    orders = table(spark, sf, "orders")
    item = F.floor(key / 4)
    items = orders.select(item.alias("item_pos")).distinct().withColumns({"podcast_name": F.lit("Show"), "episode_title": F.concat(F.lit("T"), F.col("item_pos").cast("string"))})
    found = orders.filter(key % 4 < 1 + item % 4).select(
        item.alias("item_pos"), F.struct(key.cast("int").alias("pattern_no"), F.lit(0).alias("source_no"), F.lit(0).alias("match_no")).alias("seq"),
        F.concat(F.lit("Guest "), key.cast("string")).alias("name"), F.lit("description").alias("source"), F.concat(F.lit("p"), key.cast("string")).alias("pattern"),
        F.lit("text").alias("matched_text"), F.when(status == "F", "confirmed_guest").when(status == "O", "possible_guest").otherwise("mentioned_entity").alias("decision"), F.lit("").alias("reason"))
    out = guests.guest_status(items, found, guest_hosts(spark, sf))
    return out.select(F.col("item_pos").alias("item"), F.col("guest_detection_status").alias("status"), F.array_join("guest_names", "|").alias("names"))


def named_guests(spark, sf):
    return guest_items(spark, sf).select(
        "item_pos", F.when(F.col("item_pos") % 9 == 3, "张璐").otherwise(F.col("a")).alias("guest_name"), "show_notes")


@query("guest_identity")
def guest_identity(spark, sf):
    return background.guest_identity(named_guests(spark, sf)).select("item_pos", "guest_name", F.length("context").alias("context_length"), F.array_join("facts", " | ").alias("facts"))


@query("guest_role_list")
def guest_role_list(spark, sf):
    out = background.guest_role_list(background.guest_identity(named_guests(spark, sf)))
    return out.select("item_pos", "guest_name", F.array_join("role_info.roles", "|").alias("roles"), "role_info.org", "role_info.title", "role_info.credential", "role_info.source")


@query("guest_sentence")
def guest_sentence(spark, sf):
    return background.guest_sentence(background.guest_identity(named_guests(spark, sf))).select("item_pos", "guest_name", "background_zh", "confidence")


@query("search_queries", """
SELECT c_custkey, CAST(n AS INT) AS query_no, CASE n WHEN 0 THEN c_name || ' 嘉宾 简介 背景' ELSE c_name || ' biography profile' END AS query FROM customer, (VALUES (0), (1)) v(n)""")
def search_queries(spark, sf):
    return background.search_queries(table(spark, sf, "customer").select(F.col("c_name").alias("guest_name"))).select(
        F.regexp_extract("guest_name", "#0*([0-9]+)", 1).cast("bigint").alias("c_custkey"), "query_no", "query")


def landed_searches(spark, sf):
    """Search answers landed as JSON: every nation's customers as results, in three shapes, some unusable."""
    rows = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 8).alias("answer_id"), F.struct(
        F.col("c_custkey").alias("k"), F.struct(F.col("c_name").alias("title"), F.concat(F.lit("http://x.test/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_mktsegment").alias("snippet")).alias("r")).alias("s"))
    lists = rows.groupBy("answer_id").agg(F.sort_array(F.collect_list("s"))["r"].alias("r"))  # eight per answer
    mode = F.col("answer_id") % 5
    body = (F.when(mode == 0, F.to_json(F.struct(F.col("r").alias("results")))).when(mode == 1, F.to_json(F.struct(F.col("r").alias("items")))).when(mode == 2, F.to_json("r"))
            .when(mode == 3, F.concat(F.lit("Unknown command "), F.to_json("r"))).otherwise("{broken"))
    return lists.select("answer_id", body.alias("body"))


@query("search_result_rows", """
SELECT answer_id, CAST(rn - 1 AS INT) AS rank, c_name AS title, 'http://x.test/' || c_custkey AS url, c_mktsegment AS snippet
FROM (SELECT *, c_custkey // 8 AS answer_id, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 5 AND answer_id % 5 < 3""")
def search_result_rows(spark, sf):
    return background.search_result_rows(landed_searches(spark, sf))


def _prompt_line(i: int) -> str:
    # Every result has an address that is no known site and a market segment as its snippet.
    grade = f"CASE WHEN length(s[{i}]) < 10 THEN 'weak' ELSE 'secondary' END"
    return f"CASE WHEN len(t) >= {i} THEN '[{i}[' || {grade} || ']] ' || t[{i}] || CASE WHEN s[{i}] <> '' THEN chr(10) || '   摘要：' || left(s[{i}], 200) ELSE ' (' || u[{i}] || ')' END END"


@query("guest_prompt", f"""
WITH a AS (SELECT c_custkey // 8 AS answer_id, list(c_name ORDER BY c_custkey) AS t, list('http://x.test/' || c_custkey ORDER BY c_custkey) AS u, list(c_mktsegment ORDER BY c_custkey) AS s FROM customer GROUP BY 1)
SELECT answer_id, '{background.PROMPT_HEAD}' || 'Guest ' || answer_id || '{background.PROMPT_BODY}' || concat_ws(chr(10), {', '.join(_prompt_line(i) for i in (1, 2, 3))}) || '{background.PROMPT_TAIL}' AS prompt
FROM a WHERE answer_id % 5 < 3""")
def guest_prompt(spark, sf):
    rows = background.search_result_rows(landed_searches(spark, sf))
    source = F.struct("title", "url", "snippet", source_quality(F.col("title"), F.col("url"), F.col("snippet")).alias("quality"))
    lists = rows.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("rank", source.alias("s"))))["s"].alias("sources"))  # five at most
    return lists.select("answer_id", background.guest_prompt(F.concat(F.lit("Guest "), F.col("answer_id").cast("string")), F.col("sources")).alias("prompt"))


@query("enrich_guests")
def enrich_guests(spark, sf):
    items = guest_items(spark, sf)
    status = statuses(spark, sf)
    none = F.struct(F.lit("cached text").alias("background_zh"), F.array(F.struct(F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("snippet"), F.lit("secondary").alias("quality"))).alias("sources"), F.lit("high").alias("confidence"), F.lit("cached").alias("note"))
    cache = items.filter(F.col("item_pos") % 27 == 0).select(
        background.guest_key(F.col("a"), F.lit(""), F.col("podcast_name")).alias("key"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("cached_at"),
        F.lit("confirmed_guest").alias("detection_status"), none.alias("payload")).dropDuplicates(["key"])
    found = items.filter(F.col("item_pos") % 2 == 0).select(F.col("a").alias("guest_name")).distinct().select(
        "guest_name", F.lit(0).alias("rank"), F.concat("guest_name", F.lit(" - page")).alias("title"), F.lit("https://en.wikipedia.org/wiki/x").alias("url"), F.lit("known for many things").alias("snippet"))
    out = background.enrich_guests(items, status, cache, found, F.lit("2024-02-05 00:00:00").cast("timestamp"))
    return out.select("item_pos", "guest_detection_status", F.array_join("guest_names", "|").alias("guest_names"), "guest_background_zh", "guest_background_confidence",
                      "guest_background_note", F.size("guest_background_sources").alias("n_sources"), "source_quality_summary")
