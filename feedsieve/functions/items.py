"""Item fields: best text, ids, hashes, links and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.text import clean_html, collapse_blanks, strip

# Fixed values.
MAX_NOTES = 5000
MIN_NOTES = 20
NOTE_SOURCES = ("description", "content_encoded", "itunes_summary", "itunes_subtitle")
TITLE_STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but", "is", "are", "was", "were", "这", "的",
    "是", "在", "和", "了", "我", "你", "他", "她", "它", "我们", "你们", "他们", "她们", "它们", "之", "与", "或", "但",
    "为", "而", "于", "从", "到", "把", "被", "让", "给", "向", "跟", "用",
)
CACHE_VERSION = "show_notes_zh_v2_display_filter_v2_completeness_v2"
CACHE_PREFIX = "show_notes_zh_"
PRIORITY_LABELS = {"high": "🔴 高优先级", "medium": "🟡 中优先级", "low": "⚪ 低优先级"}
SHORT_PRIORITY_LABELS = {"high": "🔴 高", "medium": "🟡 中", "low": "⚪ 低"}
FULL_LABELS = {"yes": "✅ 建议 full", "maybe": "🤔 可考虑 full", "no": "❌ 暂不需 full"}
DIMENSION_LABELS = (
    ("topic_relevance", "相关度"), ("information_density", "信息密度"), ("novelty", "新鲜度"),
    ("actionability", "行动价值"), ("strategic_value", "战略价值"), ("transcription_value", "转写价值"),
)
FALLBACKS = (
    "已确认本期嘉宾，但节目元数据未提供足够背景信息，暂不补充背景。",
    "未找到足够可靠的公开资料，暂不补充背景。",
    "未能从节目元数据中确认本期嘉宾，暂不补充背景。",
)
NOISE_TITLES = ("author", "writer", "host", "podcaster", "creator", "作家", "作者", "主持人", "主播", "创作者", "founder", "cofounder")
TOPIC_PHRASES = (
    "reshaping venture capital", "venture capital", "private markets", "software repricing", "capital allocation",
    "capital allocation strategy", "investment strategy", "market commentary", "fund performance",
)
REFUSALS = ("信息不足", "无法生成")


def select_longest_text(raws: list[Column], limit: int = MAX_NOTES) -> Column:
    """The longest cleaned field of an item, with its source, raw text and every field's length.

    Earlier fields win ties; if nothing reaches 20 characters a non-empty description is taken. The
    stored text is cut at `limit` and flagged; the lengths are those of the whole fields.
    """
    def field(rank: int, source: str, raw: Column) -> Column:
        return let(clean_html(raw), lambda text: F.struct(
            F.length(text).alias("n"), F.lit(-rank).alias("rank"), F.lit(source).alias("source"), text.alias("text"),
            F.coalesce(raw, F.lit("")).alias("raw")))

    fields = F.array(*[field(i, s, r) for i, (s, r) in enumerate(zip(NOTE_SOURCES, raws))])

    def chosen(all_fields: Column) -> Column:
        first = F.get(all_fields, F.lit(0))
        best = F.array_max(all_fields)
        pick = F.when((best["n"] < MIN_NOTES) & (first["raw"] != ""), first).otherwise(best)
        return let(pick, lambda b: F.struct(
            F.left(b["text"], F.lit(limit)).alias("show_notes"), b["raw"].alias("show_notes_raw"),
            b["source"].alias("show_notes_source"), F.least(b["n"], F.lit(limit)).alias("show_notes_text_len"),
            (b["n"] > limit).alias("show_notes_truncated"),
            *[F.get(all_fields, F.lit(i))["n"].alias(f"rss_{s}_len") for i, s in enumerate(NOTE_SOURCES)]))

    return let(fields, chosen)


def episode_id(feed_id: Column, date: Column, title: Column) -> Column:
    """feed_yyyymmdd_up to three telling title words_hash of the raw title."""
    words = F.regexp_extract_all(title, F.lit(r"(?U)\w+"), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*TITLE_STOPWORDS))
    slug = F.lower(F.array_join(F.slice(telling, 1, 3), "_"))
    return F.concat_ws("_", feed_id, F.replace(date, F.lit("-"), F.lit("")), slug, F.left(F.sha1(title), F.lit(8)))


def selection_id(episode: Column, action: Column, stamp: Column) -> Column:
    return F.concat(F.lit("sel_"), stamp, F.lit("_"), F.left(F.sha1(F.concat_ws(":", episode, action, stamp)), F.lit(6)))


def guest_key(name: Column, affiliation: Column, podcast: Column) -> Column:
    parts = [F.lower(strip(F.coalesce(c, F.lit("")))) for c in (name, affiliation, podcast)]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(24))


def source_hash(text: Column) -> Column:
    return F.sha2(collapse_blanks(text), 256)


def cache_key(podcast: Column, episode: Column, url: Column, text: Column, model: Column, version: Column | None = None, hashed: Column | None = None) -> Column:
    """Content-addressed key over the six normalised parts, as canonical JSON with sorted names. `hashed`: the text's `source_hash` where it is known."""
    def part(c: Column) -> Column:
        return F.lower(collapse_blanks(c.cast("string")))

    payload = F.to_json(F.struct(
        part(episode).alias("episode_id"), part(url).alias("episode_url"), part(model).alias("model_name"),
        part(podcast).alias("podcast_id"), (source_hash(text) if hashed is None else hashed).alias("source_hash"),
        part(F.lit(CACHE_VERSION) if version is None else version).alias("translation_version")))
    return F.concat(F.lit(CACHE_PREFIX), F.sha2(payload, 256))


def document_url(folder_url: Column, doc_id: Column) -> Column:
    host = F.coalesce(F.try_parse_url(folder_url, F.lit("HOST")), F.lit(""))
    head = F.split_part(host, F.lit("."), F.lit(1))
    return F.concat(F.lit("https://"), F.when(head != "", F.concat(head, F.lit("."))).otherwise(""), F.lit("feishu.cn/docx/"), doc_id)


def labelled(value: Column, labels: dict[str, str]) -> Column:
    out = value
    for key, label in labels.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def dimension_line(dims: dict[str, Column]) -> Column:
    return F.concat_ws(" | ", *[F.when(dims[n].isNotNull(), F.concat(F.lit(label + " "), dims[n].cast("string")))
                                for n, label in DIMENSION_LABELS])


def is_fallback(text: Column) -> Column:
    """Background text that only says there is none, alone or repeated with semicolons."""
    def judged(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, "[；;]", -1), strip), lambda p: p != "")
        repeated = F.contains(t, F.lit(FALLBACKS[0])) & t.rlike("[；;]") & F.forall(parts, lambda p: p.isin(*FALLBACKS))
        return (t == "") | t.isin(*FALLBACKS) | repeated

    return let(F.coalesce(text, F.lit("")), judged)


def is_source_noise(snippet: Column) -> Column:
    """Snippet without content: empty, a topic phrase, or nothing but generic job titles."""
    def judged(s: Column) -> Column:
        low = F.lower(s)
        topic = F.exists(F.array(*[F.lit(p) for p in TOPIC_PHRASES]), lambda p: F.contains(low, p))
        bare = F.lower(strip(F.replace(F.replace(s, F.lit("职务/头衔："), F.lit("")), F.lit("机构/公司："), F.lit(""))))
        parts = F.filter(F.transform(F.split(bare, "[/,;|]", -1), strip), lambda p: p != "")
        return (s == "") | topic | F.forall(parts, lambda p: p.isin(*NOISE_TITLES))

    return let(F.coalesce(snippet, F.lit("")), judged)


def accept_generated(text: Column) -> Column:
    def ok(t: Column) -> Column:
        return (F.length(t) >= 20) & ~F.contains(t, F.lit(REFUSALS[0])) & ~F.contains(t, F.lit(REFUSALS[1]))

    return let(strip(F.coalesce(text, F.lit(""))), ok)
