"""Reports, document blocks, notifications and subtitles as ordered line and block tables.

A report is a table of numbered lines, not one string: a run may hold any number of items, and no task
ever gathers a whole run. `write_lines` stores it in order as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.items import (
    DIMENSION_LABELS, FULL_LABELS, PRIORITY_LABELS, SHORT_PRIORITY_LABELS, dimension_line, labelled)
from feedsieve.functions.text import clean_block_title, strip
from feedsieve.functions.when import format_duration, format_publish_date, format_window_time
from feedsieve.operators.ranking import ordinal, top_per_key

# Headings and empty-section texts of the outputs.
RULE = "━━━━━━━━━━━━━━━━━━━━━━━━"
FULL_NOTES_HEADING = "节目介绍 / Show Notes（完整）"
TRANSLATED_HEADING = "节目介绍 / Show Notes（中文翻译，原文已保留）"
REPORT_SECTIONS = (
    ("full", 1, "✅ 本周建议完整转写（Full，", "本周无 Full 推荐。", "Full"),
    ("preview", 2, "🔍 本周建议预览转写（Preview，", "本周无 Preview 推荐。", "Preview"),
    ("skip", 3, "⏭️ 本周跳过（Skip，", "本周无 Skip。", "skip"),
)
BLOCK_SECTIONS = (
    ("full", 1, "✅ Full 推荐", "本周无 Full 推荐", "Full"),
    ("preview", 2, "🔍 Preview 推荐", "本周无 Preview 推荐", "Preview"),
    ("skip", 3, "⏭️ Skip", "本周无 Skip", "skip"),
)
BLOCKS_PER_BATCH = 50


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _section_order(decision: Column) -> Column:
    return F.when(decision == "full", 1).when(decision == "preview", 2).otherwise(3)


def _score(value: Column) -> Column:
    return F.format_string("%.1f", value)



def _notes_lines(sections: Column, heading: Column) -> Column:
    title = F.when(heading == "translated", TRANSLATED_HEADING).otherwise(FULL_NOTES_HEADING)
    spaced = F.flatten(F.transform(sections, lambda s, i: F.when(i == 0, F.array(s)).otherwise(F.array(F.lit(""), s))))
    return F.concat(F.array(F.lit(""), _text("**", title, "：**")), spaced)


def item_lines() -> Column:
    """Report lines of one item as an array.

    Uses podcast_name, episode_title, duration_seconds, duration_minutes, final_score, decision,
    decision_reason_zh, one_line_summary_cn, summary_3_sentences_cn, key_points_cn, sections, heading.
    """
    name, title, score = F.col("podcast_name"), F.col("episode_title"), F.col("final_score").cast("string")
    label = F.when(F.col("decision") == "full", "Full").otherwise("Preview")
    duration = format_duration(F.col("duration_seconds"), F.col("duration_minutes"))
    one_line = F.coalesce("one_line_summary_cn", F.lit(""))
    points = F.coalesce("key_points_cn", F.array().cast("array<string>"))
    first = F.coalesce(F.get("summary_3_sentences_cn", F.lit(0)), F.lit(""))
    # The one-liner shows only where summary sentences exist at all.
    overview = F.when(F.size(F.coalesce("summary_3_sentences_cn", F.array().cast("array<string>"))) > 0,
                      strip(F.coalesce(F.nullif(one_line, F.lit("")), first))).otherwise("")
    empty = F.array().cast("array<string>")

    def point_lines(kept: Column) -> Column:
        topic = F.array(_text("- 主题：", title))
        return F.when(F.size(kept) > 1, F.transform(F.slice(kept, 2, 3), lambda p: _text("- ", p))).otherwise(topic)

    content = F.filter(points, lambda p: ~p.rlike("主题：|发布：|时长："))
    shown = F.concat(
        F.array(_text("### ", name, " | ", title, " | ", duration, " | ", score, "分 | ", label), F.lit("")),
        F.when(overview != "", F.array(_text("**概述：**", overview))).otherwise(empty),
        F.when(F.size(points) > 0, let(content, point_lines)).otherwise(empty),
        _notes_lines(F.col("sections"), F.col("heading")))
    reason = F.coalesce(F.nullif(F.col("decision_reason_zh"), F.lit("")), F.nullif(F.col("reason_zh"), F.lit("")), F.lit("评分不足"))
    skipped = F.concat(
        F.array(_text("### ", name, " | ", title, " | ", score, "分")),
        F.when(one_line != "", F.array(_text("**概述：**", one_line))).otherwise(empty),
        F.array(_text("**跳过理由：**", reason)), _notes_lines(F.col("sections"), F.col("heading")), F.array(F.lit("")))
    return F.when(F.col("decision") == "skip", skipped).otherwise(shown)


def _numbered(parts: DataFrame, column: str, out: str) -> DataFrame:
    """Explode per-item arrays into rows numbered over the whole run, without gathering the run."""
    placed = ordinal(parts, ["run_id"], ["section", "slot", "rank_key"], "pos", "_first", weight=F.size(column))
    return placed.select("run_id", "_first", F.posexplode(column).alias("_at", out)).select(
        "run_id", (F.col("_first") + F.col("_at")).alias("n"), out)



def render_report(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Numbered report lines (run_id, line_no, line).

    `runs` holds one row per run: run_id, week_id, window_start, window_end, podcast_count, total,
    error_count, full, preview, skip.
    """
    head = F.array(
        _text("📅 播客筛选报告 | ", F.col("week_id"), " | 窗口：", format_window_time(F.col("window_start")), " — ", format_window_time(F.col("window_end"))),
        _text("总计扫描：", F.col("total").cast("string"), "期节目"), _text("覆盖播客：", F.col("podcast_count").cast("string"), "个"),
        F.when(F.col("error_count") > 0, _text("Fetch错误：", F.col("error_count").cast("string"), "个")).otherwise(""), F.lit(""))

    def opening(bucket: str, order: int, label: str, nothing: str) -> Column:
        lines = F.array(F.lit(RULE), _text(label, F.col(bucket).cast("string"), "期）："), F.lit(RULE))
        lines = F.concat(F.array(F.lit("")), lines) if order > 1 else F.concat(head, lines)
        return F.concat(lines, F.when(F.col(bucket) == 0, F.array(F.lit(nothing))).otherwise(F.array().cast("array<string>")))

    tops = runs.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(o).alias("section"), F.lit(0).alias("slot"), F.lit(0.0).alias("rank_key"), F.lit(0).cast("bigint").alias("pos"),
                 opening(b, o, label, nothing).alias("lines")) for b, o, label, nothing, _ in REPORT_SECTIONS])))
    body = decisions.select(
        "run_id", _section_order(F.col("decision")).alias("section"), F.lit(1).alias("slot"), (-F.col("final_score")).alias("rank_key"),
        F.col("item_pos").cast("bigint").alias("pos"), item_lines().alias("lines"))
    return _numbered(tops.unionByName(body), "lines", "line").withColumnRenamed("n", "line_no")


def _block(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def item_blocks() -> Column:
    """Document blocks of one item: array<struct(type, text)>."""
    name = F.col("podcast_name")
    dims = {n: F.col(n) for n, _ in DIMENSION_LABELS}
    when = format_publish_date(F.col("pub_datetime"))
    duration = format_duration(F.col("duration_seconds"), F.col("duration_minutes"))
    title = clean_block_title(F.col("episode_title"))
    unsure = F.coalesce("uncertainty_zh", F.lit(""))
    reason = F.coalesce(F.nullif(F.col("decision_reason_zh"), F.lit("")), F.nullif(F.col("reason_zh"), F.lit("")), F.lit(""))
    none = F.array().cast("array<struct<type:string,text:string>>")

    def only(test: Column, block: Column) -> Column:
        return F.when(test, F.array(block)).otherwise(none)

    label = F.when(F.col("decision") == "full", "Full").when(F.col("decision") == "preview", "Preview").otherwise("skip")
    first = F.array(_block("para", F.concat_ws(" | ", name, title, when, duration, _text(_score(F.col("final_score")), "分"), label)))
    heading = F.when(F.col("heading") == "translated", TRANSLATED_HEADING).otherwise(FULL_NOTES_HEADING)
    notes = F.concat(F.array(_block("h3", heading)), F.transform(F.col("sections"), lambda s: _block("para", s)),
                     F.array(_block("para", F.lit(""))))
    known = F.col("priority").isNotNull()
    shown = F.concat(
        first,
        only(known, _block("para", _text("本周关注优先级：", labelled(F.col("priority"), PRIORITY_LABELS), " | Full建议：",
                                         labelled(F.col("full_suggestion"), FULL_LABELS)))),
        only(F.col("selection_policy_mode") == "all_preview", _block("para", F.lit("处理状态：已进入 preview"))),
        F.array(_block("para", _text("评分维度：", dimension_line(dims)))),
        only(unsure != "", _block("para", _text("不确定性：", unsure))), notes)
    skipped = F.concat(
        first,
        only(known, _block("para", _text("推荐优先级：", labelled(F.col("priority"), SHORT_PRIORITY_LABELS), " | Full建议：", F.col("full_suggestion")))),
        only(reason != "", _block("para", _text("跳过理由：", reason))),
        only(unsure != "", _block("para", _text("注意：", unsure))), notes)
    return F.when(F.col("decision") == "skip", skipped).otherwise(shown)


def report_blocks(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Document blocks of a run in order: run_id, block_no (from 1), type, text."""
    errors = F.col("error_count").cast("string")
    head = F.array(
        _block("h1", _text("🎧 播客周报 ", F.col("week_id"))), _block("para", F.lit("")),
        _block("para", _text("窗口：", F.col("window_start"), " → ", F.col("window_end"))),
        _block("para", _text("扫描日期：", F.col("scan_date"))), _block("para", _text("总计节目：", F.col("total").cast("string"))),
        _block("para", _text("Full / Preview / Skip：", F.concat_ws(" / ", *[F.col(c).cast("string") for c in ("full", "preview", "skip")]))),
        _block("para", _text("Fetch 错误：", errors, " 个")))

    def opening(bucket: str, order: int, label: str, nothing: str) -> Column:
        blocks = F.array(_block("h2", F.lit(label)))
        if order == 1:
            blocks = F.concat(head, blocks)
        return F.when(F.col(bucket) == 0, F.concat(blocks, F.array(_block("bullet", F.lit(nothing))))).otherwise(blocks)

    tops = runs.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(o).alias("section"), F.lit(0).alias("slot"), F.lit(0.0).alias("rank_key"), F.lit(0).cast("bigint").alias("pos"),
                 opening(b, o, label, nothing).alias("blocks")) for b, o, label, nothing, _ in BLOCK_SECTIONS])))
    body = decisions.select(
        "run_id", _section_order(F.col("decision")).alias("section"), F.lit(1).alias("slot"), (-F.col("final_score")).alias("rank_key"),
        F.col("item_pos").cast("bigint").alias("pos"), item_blocks().alias("blocks"))
    rows = _numbered(tops.unionByName(body), "blocks", "block")
    return rows.select("run_id", F.col("n").alias("block_no"), "block.type", "block.text")


def block_batches(blocks: DataFrame, size: int = BLOCKS_PER_BATCH) -> DataFrame:
    """Batches of blocks with their start index; a batch never exceeds `size` rows."""
    batch = F.floor((F.col("block_no") - 1) / size)
    return blocks.groupBy("run_id", batch.alias("batch_no")).agg(
        F.min(F.col("block_no") - 1).alias("start_index"), F.count("*").alias("n_blocks"),
        F.sort_array(F.collect_list(F.struct("block_no", "type", "text"))).alias("blocks"))


def notification_rows(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Ordered notification lines per run: header, counts, warnings, three best items, link, run id."""
    best = top_per_key(decisions.filter(F.col("decision").isin("full", "preview")), ["run_id"],
                       [F.col("final_score").desc(), F.col("decision"), F.col("item_pos")], 3, "place")
    badge = F.when(F.col("decision") == "full", "✅").otherwise("🔍")
    line = _text(badge, " ", F.col("podcast_name"), " | ", F.left("episode_title", F.lit(30)), " | ",
                 F.col("duration_minutes").cast("string"), "min | ", F.col("final_score").cast("string"), "分")
    tops = best.select("run_id", (F.lit(60) + F.col("place")).alias("ord"), line.alias("text"))

    def count(name: str) -> Column:
        return F.col(name).cast("string")

    shown = F.when(F.coalesce("doc_url", F.lit("")) != "", F.col("doc_url")).otherwise("生成中（稍后查看本地文件）")
    fixed = F.array_compact(F.array(
        F.struct(F.lit(10).alias("ord"), _text("📅 ", F.col("week_id"), " | 窗口：", F.left("window_start", F.lit(10)), " ~ ", F.left("window_end", F.lit(10))).alias("text")),
        F.struct(F.lit(20).alias("ord"), _text("共扫描 ", count("total"), " 期 | ✅Full ", count("full"), " | 🔍Preview ", count("preview"), " | ⏭️Skip ", count("skip")).alias("text")),
        F.when(F.col("error_count") > 0, F.struct(F.lit(30).alias("ord"), _text("⚠️ Fetch 错误：", count("error_count"), " 个 → ", F.col("errors")).alias("text"))),
        F.when(F.col("eligible_count") > 0, F.struct(F.lit(40).alias("ord"), _text("🌐 Show Notes 翻译：", count("visible_translation_count"), "/", count("eligible_count")).alias("text"))),
        F.when(F.col("failed_count") > 0, F.struct(F.lit(45).alias("ord"), _text("⚠️ Show Notes 翻译：", count("failed_count"), " 期回退原文，请查看周报").alias("text"))),
        F.struct(F.lit(50).alias("ord"), F.lit("").alias("text")),
        F.when(F.col("full") + F.col("preview") > 0, F.struct(F.lit(60).alias("ord"), F.lit("🏆 Top 推荐：").alias("text"))),
        F.struct(F.lit(70).alias("ord"), F.lit("").alias("text")),
        F.struct(F.lit(80).alias("ord"), _text("📄 飞书周报：", shown).alias("text")),
        F.struct(F.lit(90).alias("ord"), _text("🔧 run_id：", F.col("run_id")).alias("text")),
        F.struct(F.lit(95).alias("ord"), F.lit("由 cron 自动调度，每周日 22:10 执行").alias("text"))))
    return runs.select("run_id", F.inline(fixed)).unionByName(tops)


def selection_doc_blocks(selections: DataFrame) -> DataFrame:
    """Document of each selected item: selection_id, block_no, type, text."""
    tag = F.when(F.col("action") == "full", "[Full]").otherwise("[Preview]")
    label = F.when(F.col("action") == "full", "Full 推荐转写").otherwise("Preview 预览")
    none = F.array().cast("array<struct<type:string,text:string>>")

    def bullets(column: str, nothing: str) -> Column:
        listed = F.transform(F.col(column), lambda s: _block("bullet", s))
        return F.when(F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0, listed).otherwise(F.array(_block("bullet", F.lit(nothing))))

    notes = F.coalesce("show_notes_text", F.lit(""))
    shown = F.when(F.contains(notes, F.lit("\n")), F.split(F.left(notes, F.lit(1000)), "\n", -1)).otherwise(F.array(F.left(notes, F.lit(500))))
    lines = F.filter(F.transform(shown, strip), lambda s: s != "")
    blank = F.array(_block("para", F.lit("")))
    blocks = F.concat(
        F.array(_block("h1", _text(tag, " ", F.col("episode_title"))), _block("para", F.lit("")), _block("para", _text("播客：", F.col("podcast_name"))),
                _block("para", _text("发布：", F.col("publish_date"))), _block("para", _text("评分：", F.col("score").cast("string"), "分")),
                _block("para", _text("推荐动作：", label))),
        F.when(F.coalesce("duration_minutes", F.lit(0)) > 0, F.array(_block("para", _text("时长：", F.col("duration_minutes").cast("string"), "分钟")))).otherwise(none),
        F.when(F.coalesce("audio_url", F.lit("")) != "", F.array(_block("para", _text("原始音频：", F.col("audio_url"))))).otherwise(none),
        F.array(_block("h2", F.lit("📝 内容摘要"))), bullets("summary_3_sentences_cn", "（暂无摘要，等待转写后补充）"), blank,
        F.array(_block("h2", F.lit("🔑 关键要点"))), bullets("key_points_cn", "（暂无要点，等待转写后补充）"), blank,
        F.array(_block("h2", F.lit("💡 推荐理由")), _block("para", F.coalesce("why_important", F.lit("")))), blank,
        F.when(notes != "", F.concat(F.array(_block("h2", F.lit("📋 原始 show notes（已清洗）"))), F.transform(lines, lambda s: _block("para", s)))).otherwise(none),
        blank,
        F.array(_block("para", _text("selection_id：", F.col("selection_id"))), _block("para", _text("episode_id：", F.col("episode_id"))),
                _block("para", _text("入队时间：", F.col("selected_at")))))
    return selections.select("selection_id", F.posexplode(blocks).alias("at", "block")).select(
        "selection_id", (F.col("at") + 1).alias("block_no"), "block.type", "block.text")


def write_lines(lines: DataFrame, path: str) -> None:
    """Store a line table as text files whose names follow the line order."""
    lines.repartitionByRange("run_id", "line_no").sortWithinPartitions("run_id", "line_no").select("line").write.text(path)


def clock(seconds: Column, mark: str) -> Column:
    """hh:mm:ss with milliseconds."""
    def shown(ms: Column) -> Column:
        return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)

    return let(F.greatest(F.lit(0).cast("bigint"), F.rint(seconds * 1000).cast("bigint")), shown)


def normalize_segments(segments: DataFrame) -> DataFrame:
    """Segments with text only, start at least 0, end not before start. Needs doc, idx, start, end, text."""
    text = strip(F.coalesce("text", F.lit("")))
    start = F.greatest(F.lit(0.0), F.coalesce("start", F.lit(0.0)))
    end = F.greatest(start, F.coalesce("end", start))
    return segments.select("doc", "idx", start.alias("start"), end.alias("end"), text.alias("text")).filter(F.col("text") != "")


def transcript_text(segments: DataFrame) -> DataFrame:
    """Full text per document, rebuilt from its segments (one document's segments, by construction)."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return normalize_segments(segments).groupBy("doc").agg(F.array_join(ordered["text"], " ").alias("text"))


def render_subtitles(segments: DataFrame) -> DataFrame:
    """SRT and VTT cues, numbered per document: doc, cue_no, srt, vtt.

    Cues stay rows, so a transcript of any length is spread over tasks; `write_lines` style range output
    stores them in order.
    """
    numbered = ordinal(normalize_segments(segments).withColumn("_part", F.lit(0)), ["doc"], ["_part"], "idx", "cue_no")

    def cue(mark: str) -> Column:
        return F.concat(clock(F.col("start"), mark), F.lit(" --> "), clock(F.col("end"), mark), F.lit("\n"), F.col("text"))

    return numbered.select("doc", "cue_no", F.concat(F.col("cue_no").cast("string"), F.lit("\n"), cue(",")).alias("srt"), cue(".").alias("vtt"))
