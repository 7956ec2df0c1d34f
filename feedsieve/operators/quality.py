"""Explanations, warnings, source grading and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions import keywords as kw
from feedsieve.functions.bind import let
from feedsieve.functions.text import CJK, strip, strip_html
from feedsieve.operators.ranking import top_per_key
from feedsieve.policy import Policy

# Domain lists of the source grades.
PRIMARY_DOMAINS = ("xiaoyuzhoufm.com", "xiaoyuzhoufm", "小宇宙", "podcast官方网站", "官方主页")
SECONDARY_DOMAINS = (
    "wikipedia.org", "wiki", "wikidata", "baike.baidu.com", "baidu.com/wiki", "github.com", "arxiv.org", "scholar.google",
    "medium.com", "substack.com", "nytimes.com", "wsj.com", "reuters.com", "bloomberg.com", "forbes.com", "techcrunch.com",
    "theverge.com", "wired.com", "163.com", "sina.com", "sohu.com", "ifeng.com", "tencent.com", "qq.com", "youtube.com",
    "bilibili.com", "b站", "linkedin.com",
)
WEAK_MARKS = ("搜索结果", "相关推荐", "猜你喜欢", "今日热文", "聚合站", "列表页", "导航页")
SEARCH_PAGES = ("duckduckgo", "google.com/search", "bing.com/search")

# Sentence boundary of the notes.
SENTENCE_GAP = r"(?U)(?<=[。！？.!?])\s+"


def _has_any(column: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words], F.lit(False))


def source_quality(title: Column, url: Column, snippet: Column, primary=PRIMARY_DOMAINS, secondary=SECONDARY_DOMAINS,
                   weak=WEAK_MARKS) -> Column:
    """Grade of one search result: primary, secondary or weak."""
    low_title, low_url = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    bare = (F.length(F.coalesce(snippet, F.lit(""))) < 10) & (low_url != "") & ~_has_any(low_url, secondary)
    listing = _has_any(low_title, weak) | _has_any(low_url, weak) | _has_any(low_url, SEARCH_PAGES)
    return F.when(_has_any(low_url, primary), "primary").when(listing | bare, "weak").otherwise("secondary")


def quality_label(primary: Column, secondary: Column, weak: Column) -> Column:
    return F.when(primary > 0, "primary").when((secondary > 0) & (secondary > weak), "secondary").otherwise("weak")


def source_quality_rollup(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Grade counts and overall label per key."""
    counts = graded.groupBy(*keys).agg(*[F.count_if(F.col("quality") == q).alias(f"{q}_count") for q in ("primary", "secondary", "weak")])
    return counts.withColumn("quality", quality_label(F.col("primary_count"), F.col("secondary_count"), F.col("weak_count")))


# The Chinese sentences of the next three functions are output that must read exactly so.
def uncertainty_text(note_length: Column, novelty: Column, density: Column, decision: Column) -> Column:
    clauses = F.array_compact(F.array(
        F.when(note_length < 100, "节目简介信息量有限，摘要可能存在偏差"),
        F.when((novelty < 40) & (decision != "skip"), "新鲜度评分较低，内容可能不够独特"),
        F.when((density < 40) & (decision == "full"), "信息密度一般，完整转写前建议先预览")))
    return F.concat(let(clauses, lambda c: F.when(F.size(c) == 0, "暂无明显不确定性").otherwise(F.array_join(c, "；"))), F.lit("。"))


def quality_warnings(reason: Column, notes: Column | None, pub_datetime: Column, minutes: Column, same_reason: Column | None = None, size: Column | None = None) -> Column:
    """Problems of a scored item as an array; empty when all is well. `size`: the length of the plain notes, where it is known."""
    text = F.coalesce(reason, F.lit(""))
    cjk = F.regexp_count(text, F.lit(CJK))
    english = F.regexp_count(text, F.lit("[a-zA-Z]{4,}"))
    problems = [
        F.when(cjk < 45, F.concat(F.lit("quality_warning: reason_zh 汉字不足45个（仅"), cjk.cast("string"), F.lit("个）"))),
        F.when(F.length(strip(text)) < 30, "quality_warning: reason_zh 过短（字符数不足30）"),
        F.when(english > 20, F.concat(F.lit("quality_warning: reason_zh 含过多英文单词（"), english.cast("string"), F.lit("个），可能未正确使用中文"))),
    ]
    if same_reason is not None:
        problems.append(F.when(same_reason > 1, F.concat(
            F.lit("quality_warning: reason_zh 与其他"), same_reason.cast("string"), F.lit("条 episode 重复，建议差异化"))))
    problems += [
        F.when((F.length(strip_html(notes)) if size is None else size) < 20, "quality_warning: show_notes 为空或过短，无法生成有效摘要"),
        F.when(F.coalesce(pub_datetime, F.lit("")) == "", "quality_warning: pub_datetime 缺失"),
        F.when(F.coalesce(minutes, F.lit(0)) == 0, "quality_warning: duration_minutes 缺失"),
    ]
    return F.array_compact(F.array(*problems))


def duplicate_reasons(items: DataFrame, reason: str = "reason_zh") -> DataFrame:
    """Reasons used by more than one item, with their count (counted per task first)."""
    return items.groupBy(reason).agg(F.count("*").alias("same_count")).filter(F.col("same_count") > 1)


def decision_counts(decisions: DataFrame, keys: list[str]) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.count("*").alias("total"), *[
        F.count_if(F.col("decision") == d).alias(d) for d in ("full", "preview", "skip")])


def podcast_count(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct feeds per key, by id or else by name."""
    who = F.coalesce(F.nullif(F.col("podcast_id"), F.lit("")), F.nullif(F.col("podcast_name"), F.lit("")))
    # Distinct (key, feed) pairs first: a key with very many items is reduced before it meets in one task.
    return decisions.select(*keys, who.alias("_who")).distinct().groupBy(*keys).agg(F.count("_who").alias("podcast_count"))


TRANSLATED = ("translated", "cache_hit")
PARTIAL = ("partial_translated", "partial_cache_hit")


def translation_summary(items: DataFrame, keys: list[str], order: list[str], keep: int = 20) -> DataFrame:
    """Translation health per run, with the first failed items.

    Needs should_translate, status, cache_hit, podcast_name, episode_title.
    """
    wanted = F.coalesce("should_translate", F.lit(False))
    status = F.coalesce("status", F.lit("unknown"))
    failed = wanted & ~status.isin(*TRANSLATED, *PARTIAL)
    counts = items.groupBy(*keys).agg(
        F.count("*").alias("episode_count"), F.count_if(wanted).alias("eligible_count"),
        F.count_if(wanted & status.isin(*TRANSLATED)).alias("translated_count"),
        F.count_if(wanted & status.isin(*PARTIAL)).alias("partial_count"),
        F.count_if(failed).alias("failed_count"), F.count_if(~wanted).alias("skipped_count"),
        F.count_if(wanted & F.coalesce("cache_hit", F.lit(False))).alias("cache_hit_count"),
        F.count_if(wanted & status.isin(*TRANSLATED, *PARTIAL)).alias("visible_translation_count"))
    first = top_per_key(items.filter(failed).select(*keys, *order, "podcast_name", "episode_title", status.alias("status")),
                        keys, [F.col(c) for c in order], keep)
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "_rank", F.col("podcast_name").alias("podcast"), F.col("episode_title").alias("title"), "status"))).alias("failed_episodes"))
    return counts.join(listed, keys, "left")


HEAD = 1000
#: All that a reason and its warnings take from an item's texts.
QUOTED = ("_title", "_hits", "_quote", "_size")


def with_quote(items: DataFrame, policy: Policy) -> DataFrame:
    """Adds the start of the first sentence that holds an interest word, and the length of the notes (_quote, _size). Needs _notes."""
    boost = policy.interests.boost

    def holding(parts: Column) -> Column:
        return F.get(F.filter(parts, lambda s: F.size(kw.matched_words(F.lower(s), boost)) > 0), F.lit(0))

    def first_of(parts: Column, n: Column) -> Column:
        return F.coalesce(holding(F.slice(parts, 1, F.least(n, F.lit(1)))), holding(F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))))

    # Mostly one of the first eight sentences, so those that end within the first characters are tried first, then as many of the
    # whole text, and the others are cut apart only if it is none of these. No blank follows the cut, so what is left is cut as it would have been.
    def later(rest: Column) -> Column:
        return F.when(rest.isNotNull(), holding(F.split(rest, SENTENCE_GAP, -1)))

    early = let(F.split(F.left("_notes", F.lit(HEAD)), SENTENCE_GAP, 9), lambda parts: first_of(parts, F.size(parts) - 1))
    whole = let(F.split("_notes", SENTENCE_GAP, 9), lambda parts: F.coalesce(first_of(parts, F.lit(8)), later(F.get(parts, F.lit(8)))))
    found = F.coalesce(early, whole)
    return items.withColumns({"_quote": F.left(strip(F.coalesce(found, F.lit(""))), F.lit(60)), "_size": F.length("_notes")})


# So are the sentences of this one.
def reason_text(items: DataFrame, policy: Policy) -> DataFrame:
    """Adds `reason_zh`, the assembled explanation of the score decision.

    Needs the columns of `add_scores`, or in place of the texts those of QUOTED, plus podcast_name, guest_names, guest_detection_status.
    """
    if "_quote" not in items.columns:
        return reason_text(with_quote(items, policy), policy).drop("_quote", "_size")
    likes = policy.interests
    title, size = F.col("_title"), F.col("_size")
    topic, density, novelty = F.col("topic_relevance"), F.col("information_density"), F.col("novelty")
    action, strategic, transcription = F.col("actionability"), F.col("strategic_value"), F.col("transcription_value")
    preview = F.col("score_decision") == "preview"
    head = F.left(title, F.lit(40))

    def digits(c: Column) -> Column:
        return c.cast("string")

    guests = F.when((F.size("guest_names") > 0) & F.col("guest_detection_status").isin("confirmed_guest", "possible_guest"),
                    F.array_join(F.slice("guest_names", 1, 2), "、"))
    opening = (
        F.when(guests.isNotNull(), F.concat(F.lit("「"), F.col("podcast_name"), F.lit("」本期嘉宾为 "), guests, F.lit("，节目围绕「"), head, F.lit("」展开。")))
        .when(title != "", F.concat(F.lit("「"), F.col("podcast_name"), F.lit("」本期主题为「"), head, F.lit("」。")))
        .otherwise(F.concat(F.lit("「"), F.col("podcast_name"), F.lit("」本期（标题待识别）。"))))
    matched = kw.hits_in_order(F.col("_hits"), likes.boost)
    relation = let(matched, lambda m: F.when(F.size(m) > 0, F.concat(
        F.lit("涉及话题："), F.array_join(F.slice(m, 1, 5), "、"), F.lit("，与兴趣方向存在关联。")))
        .when(topic >= 40, F.concat(F.lit("主题相关性中等（相关度"), digits(topic), F.lit("分），未直接命中核心兴趣词。")))
        .otherwise(F.concat(F.lit("主题相关性较弱（"), digits(topic), F.lit("分），兴趣方向匹配度一般。"))))

    concrete = let(F.col("_quote"), lambda s: F.when(s != "", F.concat(F.lit("节目中涉及："), s, F.lit("。"))).otherwise(""))
    motive = F.when(preview, F.when(strategic >= 50, F.concat(F.lit("含一定战略/行业信息（"), digits(strategic), F.lit("分），适合预览判断具体价值。")))
                    .when(novelty >= 50, F.concat(F.lit("话题有一定新鲜度（"), digits(novelty), F.lit("分），值得预览了解。")))
                    .when(action >= 30, F.concat(F.lit("含一定行动/策略信息（"), digits(action), F.lit("分），预览可辅助决策。")))
                    .otherwise(F.concat(F.lit("信息密度"), digits(density), F.lit("分，内容价值尚待预览确认。")))).otherwise("")
    doubts = F.array_compact(F.array(
        F.when(density < 30, "信息量偏少，show_notes 不足以判断完整价值"),
        F.when((novelty < 30) & preview, "话题新鲜度较低，可能是已有认知的重复"),
        F.when(size == 0, "暂无 show_notes，无法判断内容质量"),
        F.when(transcription < 30, "完整转写价值有限，优先预览即可")))
    doubt = let(doubts, lambda d: F.when(F.size(d) > 0, F.concat(F.lit("不确定性："), F.array_join(d, "；"), F.lit("。")))
                .otherwise("暂未发现明显不确定性。"))
    pad = F.when(size == 0, "暂无 show_notes，内容深度无法预估。").when(size < 100, "节目简介较短，具体内容价值需预览后判断。").otherwise("")
    whole = let(F.concat(opening, relation, concrete, motive, doubt), lambda r: F.concat(
        r, F.when(F.regexp_count(r, F.lit(CJK)) < 60, pad).otherwise("")))
    return items.withColumn("reason_zh", whole)
