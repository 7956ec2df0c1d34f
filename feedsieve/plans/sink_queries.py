"""Queries for stored runs, logs, reports, blocks, notifications and subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.operators import delivery, documents
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import lite_decisions, run_heads, table, with_heads, with_lite
from feedsieve.plans.catalog import query
from feedsieve.plans.filter_queries import queue_table
from feedsieve.plans.join_queries import CACHE, cache_table
from feedsieve.plans.source_queries import _stored_runs
from feedsieve.session import new_folder
from feedsieve.sources import runs


@query("write_run_result", with_lite("SELECT week_id, run_id, episode_id, decision, final_score FROM lite"))
def write_run_result(spark, sf):
    return _stored_runs(spark, sf).select("week_id", "run_id", "episode_id", "decision", "final_score")


_COUNTS = ", ".join(f"count(*) FILTER (decision = '{d}') AS \"{d}\"" for d in ("full", "preview", "skip"))


@query("run_log_append", with_lite(f"SELECT week_id, run_id, count(*) AS total, {_COUNTS} FROM lite GROUP BY week_id, run_id"))
def run_log_append(spark, sf):
    path = new_folder(spark, "run-log")
    rows = lite_decisions(spark, sf)
    log = runs.run_log_rows(rows)
    # Two appends, as two runs would do.
    runs.append_rows(log.filter(F.col("run_id") < "run_2024W03"), path)
    runs.append_rows(log.filter(F.col("run_id") >= "run_2024W03"), path)
    return spark.read.schema(log.schema).parquet(path)


@query("latest_run", with_lite("""
SELECT run_id, week_id FROM (SELECT DISTINCT run_id, week_id FROM lite) WHERE week_id NOT IN (SELECT max(week_id) FROM lite) ORDER BY run_id DESC LIMIT 1"""))
def latest_run(spark, sf):
    rows = lite_decisions(spark, sf).withColumns({"dir_run_id": F.col("run_id"), "dir_week_id": F.col("week_id")})
    newest = F.broadcast(rows.agg(F.max("week_id").alias("week_id")).withColumn("moved", F.lit(True)))  # one row
    # The newest run lies in the folder of another week, so it must be passed over.
    moved = rows.join(newest, "week_id", "left").withColumn("dir_week_id", F.when(F.col("moved"), "1999W01").otherwise(F.col("week_id")))
    reports = rows.select("run_id", "week_id")
    return runs.latest_run(moved, reports)


def _report_items(spark, sf):
    pos = F.col("item_pos").cast("string")
    none = F.array().cast("array<string>")
    return lite_decisions(spark, sf).withColumns({
        "episode_title": F.concat(F.lit("Title "), pos), "decision_reason_zh": F.concat(F.lit("reason "), pos), "reason_zh": F.lit(""),
        "one_line_summary_cn": F.when(F.col("item_pos") % 4 == 0, F.concat(F.lit("one "), pos)).otherwise(""),
        "summary_3_sentences_cn": F.array(F.concat(F.lit("sum "), pos)),
        "key_points_cn": F.when(F.col("item_pos") % 3 == 0, F.array(F.lit("a"), F.concat(F.lit("b "), pos), F.lit("时长：9"), F.lit("c"))).otherwise(none),
        "sections": F.when(F.col("item_pos") % 2 == 0, F.array(F.concat(F.lit("s1 "), pos), F.lit("s2"))).otherwise(F.array(F.concat(F.lit("s1 "), pos))),
        "heading": F.when(F.col("item_pos") % 5 == 0, "translated").otherwise("full")})


_DUR = """CASE WHEN duration_seconds > 0 AND duration_seconds < 900 THEN (duration_seconds // 60) || '分' || lpad((duration_seconds % 60)::VARCHAR, 2, '0') || '秒（短节目）'
  WHEN duration_seconds > 0 THEN (duration_seconds // 60) || '分钟' ELSE '时长未知' END"""
_HEADING = "'**' || CASE WHEN item_pos % 5 = 0 THEN '节目介绍 / Show Notes（中文翻译，原文已保留）' ELSE '节目介绍 / Show Notes（完整）' END || '：**'"
_NOTES = f"['', {_HEADING}, 's1 ' || item_pos] || CASE WHEN item_pos % 2 = 0 THEN ['', 's2'] ELSE [] END"
_LINES = f"""
body AS (SELECT run_id, CASE decision WHEN 'full' THEN 1 WHEN 'preview' THEN 2 ELSE 3 END AS sec, 1 AS slot, -final_score AS neg, item_pos AS pos, CASE WHEN decision <> 'skip' THEN
    ['### ' || podcast_name || ' | Title ' || item_pos || ' | ' || {_DUR} || ' | ' || final_score || '分 | ' || CASE decision WHEN 'full' THEN 'Full' ELSE 'Preview' END, '',
     '**概述：**' || CASE WHEN item_pos % 4 = 0 THEN 'one ' ELSE 'sum ' END || item_pos] || CASE WHEN item_pos % 3 = 0 THEN ['- b ' || item_pos, '- c'] ELSE [] END || {_NOTES}
  ELSE ['### ' || podcast_name || ' | Title ' || item_pos || ' | ' || final_score || '分'] || CASE WHEN item_pos % 4 = 0 THEN ['**概述：**one ' || item_pos] ELSE [] END
     || ['**跳过理由：**reason ' || item_pos] || {_NOTES} || [''] END AS lines FROM lite),
tops AS (
  SELECT run_id, 1 AS sec, 0 AS slot, 0e0 AS neg, 0 AS pos, ['📅 播客筛选报告 | ' || week_id || ' | 窗口：' || replace(left(window_start, 16), 'T', ' ') || ' — ' || replace(left(window_end, 16), 'T', ' '),
    '总计扫描：' || total || '期节目', '覆盖播客：20个', '', '', '{documents.RULE}', '✅ 本周建议完整转写（Full，' || n_full || '期）：', '{documents.RULE}'] || CASE WHEN n_full = 0 THEN ['本周无 Full 推荐。'] ELSE [] END AS lines FROM heads
  UNION ALL SELECT run_id, 2, 0, 0e0, 0, ['', '{documents.RULE}', '🔍 本周建议预览转写（Preview，' || n_preview || '期）：', '{documents.RULE}'] || CASE WHEN n_preview = 0 THEN ['本周无 Preview 推荐。'] ELSE [] END FROM heads
  UNION ALL SELECT run_id, 3, 0, 0e0, 0, ['', '{documents.RULE}', '⏭️ 本周跳过（Skip，' || n_skip || '期）：', '{documents.RULE}'] || CASE WHEN n_skip = 0 THEN ['本周无 Skip。'] ELSE [] END FROM heads),
parts AS (SELECT * FROM tops UNION ALL SELECT * FROM body),
flat AS (SELECT run_id, sec, slot, neg, pos, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM parts)"""


@query("render_report", with_heads("SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY sec, slot, neg, pos, i) AS line_no, line FROM flat", _LINES))
def render_report(spark, sf):
    items = _report_items(spark, sf)
    return documents.render_report(items, run_heads(items)).select("run_id", "line_no", "line")


def _block_items(spark, sf):
    d = F.col("item_pos")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (d % m + 1).cast("int"))
    return _report_items(spark, sf).withColumns({
        "priority": pick(3, "high", "medium", "low"), "full_suggestion": pick(2, "yes", "no"), "selection_policy_mode": F.lit("all_preview"),
        "uncertainty_zh": F.when(d % 4 == 1, "unsure").otherwise(""), "pub_datetime": F.concat(F.lit("Mon, "), F.date_format("pub_ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        **{n: (d % m).cast("int") for n, m in (("topic_relevance", 101), ("information_density", 97), ("novelty", 89), ("actionability", 83), ("strategic_value", 79), ("transcription_value", 73))}})


_DAY = "strftime(pub_ts + INTERVAL 8 HOURS, '%Y-%m-%d')"
_BLOCKS = f"""
bbody AS (SELECT run_id, CASE decision WHEN 'full' THEN 1 WHEN 'preview' THEN 2 ELSE 3 END AS sec, 1 AS slot, -final_score AS neg, item_pos AS pos,
  [podcast_name || ' | Title ' || item_pos || ' | ' || {_DAY} || ' | ' || {_DUR} || ' | ' || printf('%.1f', final_score) || '分 | ' || CASE decision WHEN 'full' THEN 'Full' WHEN 'preview' THEN 'Preview' ELSE 'skip' END]
  || CASE WHEN decision <> 'skip' THEN ['本周关注优先级：' || ['🔴 高优先级', '🟡 中优先级', '⚪ 低优先级'][item_pos % 3 + 1] || ' | Full建议：' || ['✅ 建议 full', '❌ 暂不需 full'][item_pos % 2 + 1], '处理状态：已进入 preview',
      '评分维度：相关度 ' || item_pos % 101 || ' | 信息密度 ' || item_pos % 97 || ' | 新鲜度 ' || item_pos % 89 || ' | 行动价值 ' || item_pos % 83 || ' | 战略价值 ' || item_pos % 79 || ' | 转写价值 ' || item_pos % 73]
      || CASE WHEN item_pos % 4 = 1 THEN ['不确定性：unsure'] ELSE [] END
    ELSE ['推荐优先级：' || ['🔴 高', '🟡 中', '⚪ 低'][item_pos % 3 + 1] || ' | Full建议：' || ['yes', 'no'][item_pos % 2 + 1], '跳过理由：reason ' || item_pos] || CASE WHEN item_pos % 4 = 1 THEN ['注意：unsure'] ELSE [] END END
  || [CASE WHEN item_pos % 5 = 0 THEN '节目介绍 / Show Notes（中文翻译，原文已保留）' ELSE '节目介绍 / Show Notes（完整）' END, 's1 ' || item_pos] || CASE WHEN item_pos % 2 = 0 THEN ['s2'] ELSE [] END || [''] AS texts FROM lite),
btops AS (
  SELECT run_id, 1 AS sec, 0 AS slot, 0e0 AS neg, 0 AS pos, ['🎧 播客周报 ' || week_id, '', '窗口：' || window_start || ' → ' || window_end, '扫描日期：2024-02-05', '总计节目：' || total,
    'Full / Preview / Skip：' || n_full || ' / ' || n_preview || ' / ' || n_skip, 'Fetch 错误：0 个', '✅ Full 推荐'] || CASE WHEN n_full = 0 THEN ['本周无 Full 推荐'] ELSE [] END AS texts FROM heads
  UNION ALL SELECT run_id, 2, 0, 0e0, 0, ['🔍 Preview 推荐'] || CASE WHEN n_preview = 0 THEN ['本周无 Preview 推荐'] ELSE [] END FROM heads
  UNION ALL SELECT run_id, 3, 0, 0e0, 0, ['⏭️ Skip'] || CASE WHEN n_skip = 0 THEN ['本周无 Skip'] ELSE [] END FROM heads),
bflat AS (SELECT run_id, sec, slot, neg, pos, unnest(texts) AS text, generate_subscripts(texts, 1) AS i FROM (SELECT * FROM btops UNION ALL SELECT * FROM bbody)),
blocks AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY sec, slot, neg, pos, i) AS block_no, text FROM bflat)"""


@query("report_blocks", with_heads("SELECT run_id, block_no, text FROM blocks", _BLOCKS))
def report_blocks(spark, sf):
    items = _block_items(spark, sf)
    return documents.report_blocks(items, run_heads(items)).select("run_id", "block_no", "text")


@query("block_batches", with_heads("""
SELECT run_id, (block_no - 1) // 50 AS batch_no, min(block_no) - 1 AS start_index, count(*) AS n_blocks, string_agg(text, '|' ORDER BY block_no) AS texts FROM blocks GROUP BY 1, 2""", _BLOCKS))
def block_batches(spark, sf):
    items = _block_items(spark, sf)
    out = documents.block_batches(documents.report_blocks(items, run_heads(items)))
    return out.select("run_id", "batch_no", "start_index", "n_blocks", F.array_join("blocks.text", "|").alias("texts"))


@query("notification_rows", with_heads("""
SELECT run_id, 10 AS ord, '📅 ' || week_id || ' | 窗口：' || left(window_start, 10) || ' ~ ' || left(window_end, 10) AS text FROM heads
UNION ALL SELECT run_id, 20, '共扫描 ' || total || ' 期 | ✅Full ' || n_full || ' | 🔍Preview ' || n_preview || ' | ⏭️Skip ' || n_skip FROM heads
UNION ALL SELECT run_id, 30, '⚠️ Fetch 错误：2 个 → a, b' FROM heads
UNION ALL SELECT run_id, 40, '🌐 Show Notes 翻译：' || n_full || '/' || total FROM heads
UNION ALL SELECT run_id, 45, '⚠️ Show Notes 翻译：' || n_skip || ' 期回退原文，请查看周报' FROM heads WHERE n_skip > 0
UNION ALL SELECT run_id, 50, '' FROM heads UNION ALL SELECT run_id, 60, '🏆 Top 推荐：' FROM heads WHERE n_full + n_preview > 0 UNION ALL SELECT run_id, 70, '' FROM heads
UNION ALL SELECT run_id, 80, '📄 飞书周报：http://doc/' || run_id FROM heads UNION ALL SELECT run_id, 90, '🔧 run_id：' || run_id FROM heads UNION ALL SELECT run_id, 95, '由 cron 自动调度，每周日 22:10 执行' FROM heads
UNION ALL SELECT run_id, CAST(60 + place AS INT), CASE decision WHEN 'full' THEN '✅' ELSE '🔍' END || ' ' || podcast_name || ' | Title ' || item_pos || ' | ' || duration_minutes || 'min | ' || final_score || '分'
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY final_score DESC, decision, item_pos) AS place FROM lite WHERE decision <> 'skip') WHERE place <= 3"""))
def notification_rows(spark, sf):
    items = _report_items(spark, sf)
    heads = run_heads(items).withColumns({
        "error_count": F.lit(2), "errors": F.lit("a, b"), "eligible_count": F.col("total"), "visible_translation_count": F.col("full"), "failed_count": F.col("skip"),
        "doc_url": F.concat(F.lit("http://doc/"), F.col("run_id"))})
    return documents.notification_rows(items, heads)


_LINES_SHOWN = f"list_filter(list_transform(CASE WHEN contains(text, chr(10)) THEN string_split(left(text, 1000), chr(10)) ELSE [left(text, 500)] END, lambda s: {q.strip('s')}), lambda s: s <> '')"


@query("selection_doc_blocks", f"""
WITH b AS (SELECT 'sel_' || doc_id AS selection_id,
  [{{'type': 'h1', 'text': CASE WHEN doc_id % 2 = 0 THEN '[Full]' ELSE '[Preview]' END || ' ' || left(text, 40)}}, {{'type': 'para', 'text': ''}}, {{'type': 'para', 'text': '播客：' || source}},
   {{'type': 'para', 'text': '发布：2024-01-02'}}, {{'type': 'para', 'text': '评分：' || doc_id % 100 || '分'}}, {{'type': 'para', 'text': '推荐动作：' || CASE WHEN doc_id % 2 = 0 THEN 'Full 推荐转写' ELSE 'Preview 预览' END}}]
  || CASE WHEN doc_id % 90 > 0 THEN [{{'type': 'para', 'text': '时长：' || doc_id % 90 || '分钟'}}] ELSE [] END || [{{'type': 'para', 'text': '原始音频：http://a'}}, {{'type': 'h2', 'text': '📝 内容摘要'}}]
  || CASE WHEN doc_id % 3 = 0 THEN [{{'type': 'bullet', 'text': 's1'}}, {{'type': 'bullet', 'text': 's2'}}] ELSE [{{'type': 'bullet', 'text': '（暂无摘要，等待转写后补充）'}}] END
  || [{{'type': 'para', 'text': ''}}, {{'type': 'h2', 'text': '🔑 关键要点'}}, {{'type': 'bullet', 'text': '（暂无要点，等待转写后补充）'}}, {{'type': 'para', 'text': ''}},
      {{'type': 'h2', 'text': '💡 推荐理由'}}, {{'type': 'para', 'text': 'why'}}, {{'type': 'para', 'text': ''}}]
  || CASE WHEN text <> '' THEN [{{'type': 'h2', 'text': '📋 原始 show notes（已清洗）'}}] || list_transform({_LINES_SHOWN}, lambda s: {{'type': 'para', 'text': s}}) ELSE [] END
  || [{{'type': 'para', 'text': ''}}, {{'type': 'para', 'text': 'selection_id：sel_' || doc_id}}, {{'type': 'para', 'text': 'episode_id：' || doc_id}}, {{'type': 'para', 'text': '入队时间：now'}}] AS blocks FROM documents)
SELECT selection_id, CAST(i AS INT) AS block_no, blocks[i].type AS type, blocks[i].text AS text FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM b)""")
def selection_doc_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    empty = F.array().cast("array<string>")
    rows = docs.select(
        F.concat(F.lit("sel_"), F.col("doc_id").cast("string")).alias("selection_id"), F.when(F.col("doc_id") % 2 == 0, "full").otherwise("preview").alias("action"),
        F.left("text", F.lit(40)).alias("episode_title"), F.col("source").alias("podcast_name"), F.lit("2024-01-02").alias("publish_date"), (F.col("doc_id") % 100).alias("score"),
        (F.col("doc_id") % 90).cast("int").alias("duration_minutes"), F.lit("http://a").alias("audio_url"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("s1"), F.lit("s2"))).otherwise(empty).alias("summary_3_sentences_cn"),
        empty.alias("key_points_cn"), F.lit("why").alias("why_important"), F.col("text").alias("show_notes_text"), F.col("doc_id").cast("string").alias("episode_id"), F.lit("now").alias("selected_at"))
    return documents.selection_doc_blocks(rows)


@query("enqueue_selections", """
SELECT 'sel_' || s || '_' || left(sha1(o_custkey || ':full:' || s), 6) AS selection_id, run_id, 'manual' AS week_id, o_custkey::VARCHAR AS episode_id, 'full' AS action, strftime(t, '%Y-%m-%dT%H:%M:%S') || '+0800' AS selected_at, 'queued' AS status
FROM (SELECT *, 'run_' || year(o_orderdate) AS run_id, o_orderdate + INTERVAL 8 HOURS AS t, strftime(o_orderdate + INTERVAL 8 HOURS, '%Y%m%d%H%M%S') AS s FROM orders WHERE month(o_orderdate) BETWEEN 4 AND 6)""")
def enqueue_selections(spark, sf):
    from feedsieve.plans.join_queries import run_windows

    at = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("episode_id"), F.lit("full").alias("action"), at.alias("published_at"), at.alias("selected_ts"),
        F.concat(F.lit("run_"), F.year("o_orderdate").cast("string")).alias("run_id"), F.lit(None).cast("string").alias("week_id"), F.lit(None).cast("string").alias("podcast_id"))
    return delivery.enqueue_selections(rows, run_windows(spark, sf)).drop("podcast_id")



def _stamp(x: str, mark: str) -> str:
    return f"(lpad(({x} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({x} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({x} % 60)::VARCHAR, 2, '0') || '{mark}500')"


def segments(spark, sf):
    """Turns as transcript segments; every fifth is blank and every seventh ends before it starts."""
    rows = table(spark, sf, "conversations")
    start = F.col("turn") * 700 + 0.5
    return rows.select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), start.alias("start"), F.when(F.col("turn") % 7 == 6, 0.25).otherwise(start + 4).alias("end"),
        F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("text"))


_SEGMENTS = f"""
segs AS (SELECT conv_id AS doc, turn AS idx, turn * 700 AS s, CASE WHEN turn % 7 = 6 THEN turn * 700 ELSE turn * 700 + 4 END AS e, {q.strip('text')} AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 5 <> 4)"""


@query("render_subtitles", f"""
WITH {_SEGMENTS.strip()} SELECT doc, n AS cue_no, n || chr(10) || {_stamp('s', ',')} || ' --> ' || {_stamp('e', ',')} || chr(10) || text AS srt,
  {_stamp('s', '.')} || ' --> ' || {_stamp('e', '.')} || chr(10) || text AS vtt FROM segs""")
def render_subtitles(spark, sf):
    return documents.render_subtitles(segments(spark, sf))


@query("normalize_segments", f"""WITH {_SEGMENTS.strip()} SELECT doc, idx, s + 5e-1 AS "start", e + 5e-1 AS "end", text FROM segs""")
def normalize_segments(spark, sf):
    return documents.normalize_segments(segments(spark, sf))


@query("transcript_text", f"WITH {_SEGMENTS.strip()} SELECT doc, string_agg(text, ' ' ORDER BY idx) AS text FROM segs GROUP BY doc")
def transcript_text(spark, sf):
    return documents.transcript_text(segments(spark, sf))


@query("append_processing_log", """
SELECT 'sel_' || o_orderkey AS selection_id, CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'success' END AS status, CASE o_orderstatus WHEN 'P' THEN 'no folder' ELSE '' END AS error FROM orders""")
def append_processing_log(spark, sf):
    path = new_folder(spark, "processing-log")
    rows = queue_table(spark, sf).withColumns({
        "error": F.when(F.col("status") == "error", "no folder"), "action": F.lit("full"), "started_at": F.lit("s"), "finished_at": F.lit("f")})
    log = delivery.processing_log_rows(rows)
    runs.append_rows(log, path)
    return spark.read.schema(log.schema).parquet(path).select("selection_id", "status", "error")


@query("append_delivery_log", with_lite("SELECT DISTINCT 'feishu_doc_create' AS event, run_id, week_id, 'success' AS status FROM lite"))
def append_delivery_log(spark, sf):
    path = new_folder(spark, "delivery-log")
    none = F.lit(None).cast("string")
    rows = lite_decisions(spark, sf).select("run_id", "week_id").distinct().withColumns({
        "delivered_at": F.lit("t"), "status": F.lit("success"), "doc_url": none, "doc_id": none})
    log = delivery.delivery_log_rows(rows, "feishu_doc_create")
    runs.append_rows(log, path)
    return spark.read.schema(log.schema).parquet(path).select("event", "run_id", "week_id", "status")


@query("write_cache_entries", f"WITH {CACHE.strip()} SELECT status, cached AS translated_text FROM cache WHERE status = 'ok'")
def write_cache_entries(spark, sf):
    path = new_folder(spark, "translation-cache")
    entries = cache_table(spark, sf)
    runs.write_cache_entries(entries, path)
    return spark.read.schema(entries.schema).parquet(path).select("status", "translated_text")
