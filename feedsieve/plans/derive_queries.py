"""Queries for the scalar derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsieve.functions import items as it
from feedsieve.functions import language, score, text, when
from feedsieve.operators import quality
from feedsieve.operators.translate import SNAPSHOT_VERSION, valid_snapshot
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import episodes, lite_decisions, table, TEST_POLICY, with_episodes, with_lite
from feedsieve.plans.catalog import query
from feedsieve.policy import SAFE_RUN_KEYS

P = TEST_POLICY


@query("clean_html", f"SELECT page_id, {q.clean_html('html')} AS cleaned FROM pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("cleaned"))


@query("clean_display_html", f"SELECT page_id, {q.clean_display('html')} AS cleaned FROM pages")
def clean_display_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_display_html(F.col("html")).alias("cleaned"))


@query("strip_html", f"SELECT page_id, {q.strip_html('html')} AS stripped FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped"))


_PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("clean_display_title", f"""
SELECT page_id, {q.strip(f"regexp_replace(rtrim({q.entities(_PAGE_TITLE)}, '\"'''), ' {{2,}}', ' ', 'g')")} AS title,
       {q.strip(f"regexp_replace(translate({q.entities(_PAGE_TITLE)}, '\"''', ''), ' {{2,}}', ' ', 'g')")} AS block_title
FROM pages""")
def clean_display_title(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", text.clean_title(title).alias("title"), text.clean_block_title(title).alias("block_title"))


_FIELDS = ("html", "regexp_extract(html, '(?s)<article>(.*)</article>', 1)", "regexp_extract(html, '(?s)<p>(.*?)</p>', 1)",
           "regexp_extract(html, '<title>([^<]*)</title>', 1)")


def _field_sql() -> str:
    cols = ", ".join(f"{q.clean_html(f)} AS c{i}" for i, f in enumerate(_FIELDS))
    return f"""
WITH fields AS (SELECT page_id, {cols} FROM pages),
sized AS (SELECT *, greatest(length(c0), length(c1), length(c2), length(c3)) AS best FROM fields),
picked AS (SELECT *, CASE WHEN best < 20 THEN 0 WHEN length(c0) = best THEN 0 WHEN length(c1) = best THEN 1 WHEN length(c2) = best THEN 2 ELSE 3 END AS k FROM sized),
chosen AS (SELECT *, CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS t FROM picked)
SELECT page_id, left(t, 5000) AS show_notes, CASE k WHEN 0 THEN 'description' WHEN 1 THEN 'content_encoded' WHEN 2 THEN 'itunes_summary' ELSE 'itunes_subtitle' END AS show_notes_source,
       CAST(least(length(t), 5000) AS INT) AS show_notes_text_len, length(t) > 5000 AS show_notes_truncated, CAST(length(c0) AS INT) AS rss_description_len,
       CAST(length(c1) AS INT) AS rss_content_encoded_len, CAST(length(c2) AS INT) AS rss_itunes_summary_len, CAST(length(c3) AS INT) AS rss_itunes_subtitle_len
FROM chosen"""


@query("select_longest_text", _field_sql())
def select_longest_text(spark, sf):
    html = F.col("html")
    raws = [html, F.regexp_extract(html, "(?s)<article>(.*)</article>", 1), F.regexp_extract(html, "(?s)<p>(.*?)</p>", 1),
            F.regexp_extract(html, "<title>([^<]*)</title>", 1)]
    return table(spark, sf, "pages").select("page_id", it.select_longest_text(raws).alias("b")).select("page_id", "b.*").drop("show_notes_raw")


@query("coalesce_text", f"""
WITH src AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '(?s)<p>(.*?)</p>', 1) END AS a,
  CASE WHEN page_id % 2 = 0 THEN NULL ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS b, url FROM pages)
SELECT page_id, coalesce(nullif({q.clean_display('a')}, ''), nullif({q.clean_display('b')}, ''),
  {q.clean_display("url")} || chr(10) || 'page ' || page_id) AS shown FROM src""")
def coalesce_text(spark, sf):
    a = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1))
    b = F.when(F.col("page_id") % 2 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    lines = F.array(F.col("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", text.best_display_text(a, b, F.lit(None).cast("string"), lines, F.lit("")).alias("shown"))


_SEC = "CAST((n_chars * 3) % 7200 AS BIGINT)"
_DUR = f"""CASE doc_id % 6 WHEN 0 THEN {_SEC}::VARCHAR WHEN 1 THEN ({_SEC} // 60)::VARCHAR || ':' || lpad(({_SEC} % 60)::VARCHAR, 2, '0')
  WHEN 2 THEN ({_SEC} // 3600)::VARCHAR || ':' || lpad(({_SEC} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({_SEC} % 60)::VARCHAR, 2, '0')
  WHEN 3 THEN 'PT' || ({_SEC} // 3600)::VARCHAR || 'H' || ({_SEC} // 60 % 60)::VARCHAR || 'M' || ({_SEC} % 60)::VARCHAR || 'S'
  WHEN 4 THEN 'P1DT' || ({_SEC} // 60)::VARCHAR || 'M' ELSE lang || ':' || doc_id::VARCHAR END"""


@query("parse_duration", f"""
WITH d AS (SELECT doc_id, {_SEC} AS s, {_DUR} AS duration FROM documents)
SELECT doc_id, duration, CASE doc_id % 6 WHEN 4 THEN s // 60 * 60 WHEN 5 THEN 0 ELSE s END AS seconds,
  CASE doc_id % 6 WHEN 5 THEN 0 ELSE s // 60 END AS minutes FROM d""")
def parse_duration(spark, sf):
    s = F.col("n_chars") * 3 % 7200
    h, m, r = (c.cast("string") for c in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))
    whole = F.floor(s / 60).cast("string")
    mode = F.col("doc_id") % 6
    raw = (F.when(mode == 0, s.cast("string")).when(mode == 1, F.concat(whole, F.lit(":"), F.lpad(r, 2, "0")))
           .when(mode == 2, F.concat(h, F.lit(":"), F.lpad(m, 2, "0"), F.lit(":"), F.lpad(r, 2, "0")))
           .when(mode == 3, F.concat(F.lit("PT"), h, F.lit("H"), m, F.lit("M"), r, F.lit("S")))
           .when(mode == 4, F.concat(F.lit("P1DT"), whole, F.lit("M"))).otherwise(F.concat("lang", F.lit(":"), F.col("doc_id").cast("string"))))
    out = table(spark, sf, "documents").select("doc_id", raw.alias("duration"))
    return out.withColumn("seconds", when.duration_seconds(F.col("duration"))).withColumn("minutes", F.floor(F.col("seconds") / 60))


@query("format_duration", """
SELECT doc_id, CASE WHEN s > 0 AND s < 900 THEN (s // 60) || '分' || lpad((s % 60)::VARCHAR, 2, '0') || '秒（短节目）' WHEN s > 0 THEN (s // 60) || '分钟'
  WHEN m > 0 THEN m || '分钟' ELSE '时长未知' END AS shown
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST((n_chars * 3) % 1800 AS INT) END AS s, CAST(doc_id % 8 AS INT) AS m FROM documents)""")
def format_duration(spark, sf):
    s = F.when(F.col("doc_id") % 4 == 0, 0).otherwise((F.col("n_chars") * 3 % 1800).cast("int"))
    return table(spark, sf, "documents").select("doc_id", when.format_duration(s, (F.col("doc_id") % 8).cast("int")).alias("shown"))


@query("format_window_time", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(ts, '%Y-%m-%d') || ' 00:00'
  ELSE left('week ' || event_type || ' of ' || user_id, 16) END AS shown FROM events""")
def format_window_time(spark, sf):
    ts, mode = F.col("ts"), F.col("event_id") % 4
    raw = (F.when(mode == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+0800'")).when(mode == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
           .when(mode == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.concat(F.lit("week "), F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"))))
    return table(spark, sf, "events").select("event_id", when.format_window_time(raw).alias("shown"))


@query("format_publish_date", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(date_trunc('second', ts) + INTERVAL 8 HOURS, '%Y-%m-%d') END AS shown FROM events""")
def format_publish_date(spark, sf):
    rfc = F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.when(F.col("event_id") % 3 == 1, " GMT").otherwise(" +0000"))
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(rfc)
    return table(spark, sf, "events").select("event_id", when.format_publish_date(raw).alias("shown"))


@query("document_url", """
SELECT page_id, 'https://' || split_part(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', 1) || '.feishu.cn/docx/doc' || page_id AS doc_url FROM pages""")
def document_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", it.document_url(F.col("url"), F.concat(F.lit("doc"), F.col("page_id").cast("string"))).alias("doc_url"))


@query("priority_labels", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '🔴 高优先级' WHEN 1 THEN '🟡 中优先级' WHEN 2 THEN '⚪ 低优先级' ELSE 'other' END AS priority_label,
  CASE doc_id % 3 WHEN 0 THEN '✅ 建议 full' WHEN 1 THEN '🤔 可考虑 full' ELSE '❌ 暂不需 full' END AS full_label,
  '相关度 ' || doc_id % 101 || ' | 信息密度 ' || doc_id % 97 || ' | 新鲜度 ' || doc_id % 89 || ' | 行动价值 ' || doc_id % 83 || ' | 战略价值 ' || doc_id % 79 || ' | 转写价值 ' || doc_id % 73 AS dims
FROM documents""")
def priority_labels(spark, sf):
    d = F.col("doc_id")
    priority = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "other")]), (d % 4 + 1).cast("int"))
    full = F.element_at(F.array(*[F.lit(x) for x in ("yes", "maybe", "no")]), (d % 3 + 1).cast("int"))
    dims = {n: d % m for (n, _), m in zip(it.DIMENSION_LABELS, (101, 97, 89, 83, 79, 73))}
    return table(spark, sf, "documents").select(
        "doc_id", it.labelled(priority, it.PRIORITY_LABELS).alias("priority_label"), it.labelled(full, it.FULL_LABELS).alias("full_label"),
        it.dimension_line(dims).alias("dims"))


@query("parse_publish_time", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS publish_date,
  CASE WHEN event_id % 5 = 4 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 5 WHEN 0 THEN '+0800' WHEN 1 THEN '-0530' ELSE '+0000' END END AS pub_datetime FROM events""")
def parse_publish_time(spark, sf):
    mode = F.col("event_id") % 5
    zone = F.when(mode == 0, " +0800").when(mode == 1, " -0530").when(mode == 2, " GMT").otherwise(" +0000")
    raw = F.when(mode == 4, F.concat(F.lit("on "), F.col("event_type"))).otherwise(F.concat(F.lit("Tue, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), zone))
    out = table(spark, sf, "events").select("event_id", when.publish_fields(raw).alias("p"))
    return out.select("event_id", F.col("p.date").alias("publish_date"), F.col("p.iso").alias("pub_datetime"))


@query("normalize_publish_time", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' WHEN 0 THEN strftime(date_trunc('second', ts) - INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%SZ')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS normalized FROM events""")
def normalize_publish_time(spark, sf):
    mode = F.col("event_id") % 4
    rfc = F.concat(F.lit("Sat, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0800"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [F.when(mode == 0, rfc).otherwise("nothing"), F.when(mode == 1, iso), F.when(mode == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.col("event_type")]
    return table(spark, sf, "events").select("event_id", when.normalize_publish_time(fields).alias("normalized"))


_STOP = "[" + ", ".join(q.lit(w) for w in it.TITLE_STOPWORDS) + "]"


@query("episode_id", with_episodes(f"""
SELECT item_pos, podcast_id || '_' || replace(publish_date, '-', '') || '_' || lower(array_to_string(list_filter(
  regexp_extract_all(episode_title, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, lower(w)))[1:3], '_')) || '_' || left(sha1(episode_title), 8) AS episode_id
FROM episodes"""))
def episode_id(spark, sf):
    return episodes(spark, sf).select("item_pos", it.episode_id(F.col("podcast_id"), F.col("publish_date"), F.col("episode_title")).alias("episode_id"))


_WS = "make_timestamp((e - ((e - 309600) % 604800)) * 1000000)"


def _label(start: str) -> str:
    return f"isoyear({start} + INTERVAL 10 HOURS) || 'W' || lpad(week({start} + INTERVAL 10 HOURS)::VARCHAR, 2, '0')"


@query("business_week", f"""
WITH t AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS e FROM orders), s AS (SELECT o_orderkey, {_WS} AS w FROM t)
SELECT o_orderkey, strftime(w, '%Y-%m-%dT%H:%M:%S') AS week_start, {_label('w')} AS week_id,
  strftime(w - INTERVAL 7 DAYS, '%Y-%m-%dT%H:%M:%S') AS done_start, strftime(w, '%Y-%m-%dT%H:%M:%S') AS done_end, {_label('(w - INTERVAL 7 DAYS)')} AS done_id FROM s""")
def business_week(spark, sf):
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    shape = "yyyy-MM-dd'T'HH:mm:ss"
    out = table(spark, sf, "orders").select("o_orderkey", when.week_start(at).alias("w"), when.completed_week(at).alias("d"))
    return out.select("o_orderkey", F.date_format("w", shape).alias("week_start"), when.week_id(F.col("w")).alias("week_id"),
                      F.date_format("d.start", shape).alias("done_start"), F.date_format("d.end", shape).alias("done_end"), F.col("d.week_id").alias("done_id"))


@query("check_week_id", with_episodes("""
SELECT item_pos, item_pos % 13 <> 0 AS id_matches, item_pos % 11 <> 0 AND item_pos % 13 <> 0 AS partition_matches FROM episodes"""))
def check_week_id(spark, sf):
    eps = episodes(spark, sf, with_texts=False)
    stored = F.when(F.col("item_pos") % 13 == 0, "1999W01").otherwise(F.col("week_id"))
    folder = F.when(F.col("item_pos") % 11 == 0, "1999W02").otherwise(F.col("week_id"))
    return eps.select("item_pos", (when.week_id(F.col("week_start")) == stored).alias("id_matches"), (folder == stored).alias("partition_matches"))


def _scored(spark, sf):
    return score.add_scores(episodes(spark, sf), P)


@query("strategic_and_actionability", with_episodes("SELECT item_pos, strategic_value, actionability FROM dims", q.scored(P)))
def strategic_and_actionability(spark, sf):
    return _scored(spark, sf).select("item_pos", "strategic_value", "actionability")


@query("topic_relevance", with_episodes("SELECT item_pos, topic_relevance FROM dims", q.scored(P)))
def topic_relevance(spark, sf):
    return _scored(spark, sf).select("item_pos", "topic_relevance")


@query("novelty", with_episodes("SELECT item_pos, novelty FROM dims", q.scored(P)))
def novelty(spark, sf):
    return _scored(spark, sf).select("item_pos", "novelty")


@query("information_density", with_episodes("SELECT item_pos, information_density FROM dims", q.scored(P)))
def information_density(spark, sf):
    return _scored(spark, sf).select("item_pos", "information_density")


@query("transcription_value", with_episodes("SELECT item_pos, transcription_value FROM dims", q.scored(P)))
def transcription_value(spark, sf):
    return _scored(spark, sf).select("item_pos", "transcription_value")


@query("final_score", with_episodes("SELECT item_pos, final_score FROM scored", q.scored(P)))
def final_score(spark, sf):
    return _scored(spark, sf).select("item_pos", "final_score")


@query("score_decision", with_episodes("SELECT item_pos, score_decision FROM judged", q.scored(P)))
def score_decision(spark, sf):
    return _scored(spark, sf).select("item_pos", "score_decision")


def _legacy_sql() -> str:
    likes = P.interests
    low = "lower(episode_title || ' ' || show_notes)"

    def total(words, points):
        return " + ".join(f"CASE WHEN contains(low, {q.lit(w.lower())}) THEN {points} ELSE 0e0 END" for w in words)

    return with_episodes(f"""
SELECT item_pos, greatest(0e0, least(10e0, CASE WHEN {q.has_any('low', [w.lower() for w in likes.negative])} THEN least(b, 3e0) ELSE b END
  + {total(likes.people + likes.topics, '1e0')})) AS legacy_score
FROM (SELECT item_pos, low, 5e0 + {total(likes.boost, '5e-1')} AS b FROM (SELECT item_pos, {low} AS low FROM episodes))""")


@query("legacy_score", _legacy_sql())
def legacy_score(spark, sf):
    whole = F.concat("episode_title", F.lit(" "), "show_notes")
    return episodes(spark, sf).select("item_pos", score.legacy_score(whole, P.interests).alias("legacy_score"))


_VERDICT = ("CASE WHEN reason_code IN ('valid_episode', 'valid_short_episode') THEN 'preview' ELSE 'skip' END")


@query("classify_episode", with_episodes(f"SELECT item_pos, {_VERDICT} AS decision, reason_code FROM classified",
                                         f"base_text AS (SELECT *, {q.strip_html('show_notes')} AS t_notes FROM episodes)", q.classified(P, "base_text")))
def classify_episode(spark, sf):
    verdict = score.classify(*[F.col(c) for c in ("episode_title", "show_notes", "audio_url", "duration_seconds", "duration_minutes")], P)
    return episodes(spark, sf).select("item_pos", verdict.alias("v")).select("item_pos", "v.decision", "v.reason_code")


@query("full_suggestion", with_episodes(f"""
SELECT item_pos, CASE WHEN topic_relevance <= 0 AND greatest(strategic_value, actionability) < 40 THEN 'no'
  WHEN final_score >= {P.yes_score} OR transcription_value >= {P.yes_transcription} THEN 'yes'
  WHEN final_score >= {P.maybe_score} OR transcription_value >= {P.maybe_transcription} THEN 'maybe' ELSE 'no' END AS full_suggestion FROM judged""", q.scored(P)))
def full_suggestion(spark, sf):
    cols = [F.col(c) for c in ("final_score", "transcription_value", "topic_relevance", "strategic_value", "actionability")]
    return _scored(spark, sf).select("item_pos", score.full_suggestion(*cols, P).alias("full_suggestion"))


@query("uncertainty_text", with_episodes("""
SELECT item_pos, CASE WHEN c = '' THEN '暂无明显不确定性' ELSE c END || '。' AS uncertainty_zh
FROM (SELECT item_pos, concat_ws('；', CASE WHEN length(t_notes) < 100 THEN '节目简介信息量有限，摘要可能存在偏差' END,
  CASE WHEN novelty < 40 AND score_decision <> 'skip' THEN '新鲜度评分较低，内容可能不够独特' END,
  CASE WHEN information_density < 40 AND score_decision = 'full' THEN '信息密度一般，完整转写前建议先预览' END) AS c FROM judged)""", q.scored(P)))
def uncertainty_text(spark, sf):
    return _scored(spark, sf).select("item_pos", quality.uncertainty_text(
        F.length("_notes"), F.col("novelty"), F.col("information_density"), F.col("score_decision")).alias("uncertainty_zh"))


@query("reason_text")
def reason_text(spark, sf):
    named = _scored(spark, sf).withColumns({
        "guest_names": F.array(F.concat(F.lit("Guest "), F.col("language"))),
        "guest_detection_status": F.when(F.col("item_pos") % 4 == 0, "confirmed_guest").otherwise("no_guest_detected")})
    return quality.reason_text(named, P).select("item_pos", "score_decision", "reason_zh")


@query("quality_warnings", f"""
WITH r AS (SELECT doc_id, text, n_chars, text AS reason, lang FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY reason) AS same, length(regexp_replace(reason, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS cjk,
  len(regexp_extract_all(reason, '[a-zA-Z]{{4,}}')) AS en FROM r)
SELECT doc_id, concat_ws(' / ', CASE WHEN cjk < 45 THEN 'quality_warning: reason_zh 汉字不足45个（仅' || cjk || '个）' END,
  CASE WHEN length({q.strip('reason')}) < 30 THEN 'quality_warning: reason_zh 过短（字符数不足30）' END,
  CASE WHEN en > 20 THEN 'quality_warning: reason_zh 含过多英文单词（' || en || '个），可能未正确使用中文' END,
  CASE WHEN same > 1 THEN 'quality_warning: reason_zh 与其他' || same || '条 episode 重复，建议差异化' END,
  CASE WHEN length({q.strip_html('text')}) < 20 THEN 'quality_warning: show_notes 为空或过短，无法生成有效摘要' END,
  CASE WHEN doc_id % 5 = 0 THEN 'quality_warning: pub_datetime 缺失' END, CASE WHEN doc_id % 7 = 0 THEN 'quality_warning: duration_minutes 缺失' END) AS warnings FROM c""")
def quality_warnings(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("text").alias("reason"))
    same = quality.duplicate_reasons(docs, "reason")
    joined = docs.join(same, "reason", "left")
    found = quality.quality_warnings(F.col("reason"), F.col("text"), F.when(F.col("doc_id") % 5 != 0, "2024-01-01"),
                                     F.when(F.col("doc_id") % 7 != 0, 10), F.coalesce("same_count", F.lit(1)))
    return joined.select("doc_id", F.array_join(found, " / ").alias("warnings"))


_LANG = """
counted AS (SELECT doc_id, lang, length(regexp_replace(p, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS cjk, length(regexp_replace(p, '[^A-Za-z]', '', 'g')) AS latin
  FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(t, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+\\b', ' ', 'g') AS p FROM shown)),
found AS (SELECT *, CASE WHEN cjk + latin = 0 THEN 'unknown' WHEN cjk >= 20 AND cjk / (cjk + latin) >= 25e-2 THEN 'zh' WHEN latin >= 80 AND latin / (cjk + latin) >= 65e-2 THEN 'en'
  WHEN cjk + latin < 80 THEN 'unknown' WHEN cjk >= 10 AND latin >= 40 THEN 'mixed' ELSE 'unknown' END AS detected FROM counted)"""
_ZH = "节目讨论能源与市场"
_MIXED = f"CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat('{_ZH}', 5) || text WHEN 2 THEN '{_ZH}一二三' || text ELSE lang || text END"


def _mixed():
    d = F.col("doc_id") % 4
    return (F.when(d == 0, F.col("text")).when(d == 1, F.concat(F.repeat(F.lit(_ZH), 5), F.col("text")))
            .when(d == 2, F.concat(F.lit(_ZH + "一二三"), F.col("text"))).otherwise(F.concat("lang", "text")))


_LANG_WITH = f"WITH shown AS (SELECT doc_id, lang, {q.clean_display(_MIXED)} AS t FROM documents), {_LANG.strip()}"


@query("detect_language", f"{_LANG_WITH} SELECT doc_id, detected FROM found")
def detect_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", language.detect_language(_mixed()).alias("detected"))


@query("needs_translation", f"""{_LANG_WITH}
SELECT doc_id, CASE WHEN lang = 'de' THEN false WHEN lang = 'en' THEN detected = 'en' OR (detected NOT IN ('zh', 'mixed') AND latin >= 40 AND cjk < 10 AND latin / (cjk + latin) >= 75e-2)
  ELSE detected = 'en' END AS needed FROM found""")
def needs_translation(spark, sf):
    declared = F.when(F.col("lang") == "de", "zh").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", language.needs_translation(_mixed(), declared).alias("needed"))


@query("residual_language")
def residual_language(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", language.residual_latin(_mixed()).alias("r"))
    return out.select("doc_id", "r.*")


_ENDS = "regexp_matches(text, '[.!?。！？…][\\]\\)）}\"''’”]*$')"


@query("source_completeness", f"""
SELECT doc_id, CAST(length(text) AS INT) AS source_length, {_ENDS} AS terminal_punctuation_present, doc_id % 6 = 0 AS upstream_truncated,
  doc_id % 6 = 0 OR (length(text) >= 500 AND NOT {_ENDS}) AS suspected_source_truncation,
  concat_ws(',', CASE WHEN doc_id % 6 = 0 THEN 'upstream_truncated' END, CASE WHEN length(text) >= 500 AND NOT {_ENDS} THEN 'long_unterminated_source' END) AS reasons
FROM documents""")
def source_completeness(spark, sf):
    docs = table(spark, sf, "documents")
    out = docs.select("doc_id", language.source_completeness(
        F.col("text"), F.col("text"), F.col("doc_id") % 6 == 0, F.col("source"), F.col("n_chars").cast("int")).alias("c"))
    return out.select("doc_id", "c.source_length", "c.terminal_punctuation_present", "c.upstream_truncated", "c.suspected_source_truncation",
                      F.array_join("c.reasons", ",").alias("reasons"))


@query("valid_snapshot", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 AND len(s) > 0 THEN array_to_string(s, '|') END AS sections
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM documents)""")
def valid_snapshot_query(spark, sf):
    sections = F.split("text", "\n", -1)
    version = F.when(F.col("doc_id") % 3 == 0, SNAPSHOT_VERSION).otherwise("older")
    heading = F.when(F.col("doc_id") % 5 == 0, "none").otherwise("full")
    return table(spark, sf, "documents").select("doc_id", F.array_join(valid_snapshot(version, heading, sections), "|").alias("sections"))


def _flat(x: str) -> str:
    return q.strip(f"regexp_replace({x}, '[\\s\\x{{a0}}\\x{{3000}}\\x{{85}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{1680}}\\x{{0b}}]+', ' ', 'g')")


@query("cache_key", f"""
SELECT doc_id, sha256({_flat('text')}) AS source_hash, 'show_notes_zh_' || sha256('{{"episode_id":"ep ' || doc_id || '","episode_url":"","model_name":"mock a","podcast_id":"' || lower(source)
  || '","source_hash":"' || sha256({_flat('text')}) || '","translation_version":"{it.CACHE_VERSION}"}}') AS cache_key FROM documents""")
def cache_key(spark, sf):
    episode = F.concat(F.lit(" EP  "), F.col("doc_id").cast("string"))
    key = it.cache_key(F.upper("source"), episode, F.lit(None).cast("string"), F.col("text"), F.lit("Mock A"))
    return table(spark, sf, "documents").select("doc_id", it.source_hash(F.col("text")).alias("source_hash"), key.alias("cache_key"))


@query("guest_key", "SELECT c_custkey, left(sha256(lower(c_name) || '|' || lower(c_mktsegment) || '|nation ' || c_nationkey), 24) AS key FROM customer")
def guest_key(spark, sf):
    podcast = F.concat(F.lit("  Nation "), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", it.guest_key(F.col("c_name"), F.col("c_mktsegment"), podcast).alias("key"))


@query("selection_id", """
SELECT event_id, 'sel_' || strftime(ts, '%Y%m%d%H%M%S') || '_' || left(sha1(user_id || ':' || event_type || ':' || strftime(ts, '%Y%m%d%H%M%S')), 6) AS selection_id FROM events""")
def selection_id(spark, sf):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    return table(spark, sf, "events").select("event_id", it.selection_id(F.col("user_id").cast("string"), F.col("event_type"), stamp).alias("selection_id"))



@query("safe_run_metadata", with_lite("""
SELECT DISTINCT run_id, 'false' AS enabled, 'mock' AS mode, '' AS agent_id, 'model-' || week_id AS model FROM lite"""))
def safe_run_metadata(spark, sf):
    runs = lite_decisions(spark, sf).select("run_id", "week_id").distinct()
    config = F.create_map(*[F.lit(x) for x in ("enabled", "false", "mode", "mock", "secret_token", "hidden", "cache_dir", "somewhere")], F.lit("model"),
                          F.concat(F.lit("model-"), F.col("week_id")))
    return runs.select("run_id", *[F.coalesce(F.try_element_at(config, F.lit(k)), F.lit("")).alias(k) for k in SAFE_RUN_KEYS])
