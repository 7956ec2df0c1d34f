"""Six 0-100 dimensions, their weighted score, and the decisions drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions import keywords as kw
from feedsieve.functions.bind import let, let_sql
from feedsieve.functions.text import clean_title, strip, strip_html, unescape
from feedsieve.policy import Interests, Policy

# Length curve, weights and point values.
LENGTH_CURVE = ((0, 0), (80, 10), (200, 20), (500, 35), (1000, 45), (2500, 55), (5000, 60))
WEIGHTS = (
    ("topic_relevance", 25),
    ("information_density", 15),
    ("novelty", 15),
    ("actionability", 15),
    ("strategic_value", 20),
    ("transcription_value", 10),
)
# The ranges in front of && settle letters and blanks with two comparisons; they hold all of the set.
SENTENCE_END = "[!-?。-？&&[。！？.!?]]+"
# More than five parts, found without cutting any: nothing is tried twice, and what follows the fifth end is not read.
FIVE_ENDS = rf"(?s)\A(?>.*?{SENTENCE_END}+){{5}}"
BULLET_LINE = r"(?mdU)^\s*(?:[-*•·]|\d+[.)])\s+"
CLOCK_TIME = r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\b"
# "At least twelve letters", written out: stops at the twelfth instead of collecting them all.
TWELVE_LETTERS = "(?s)" + r"[A-Za-z\x{4e00}-\x{9fff}][^A-Za-z\x{4e00}-\x{9fff}]*+" * 11 + r"[A-Za-z\x{4e00}-\x{9fff}]"
TRAILER_PHRASES = ("trailer", "preview episode", "announcement", "sneak peek", "节目预告", "内容预告")
PAYWALL_NOTES = r"(?isU)\bsubscribe\b.{0,160}\bfull[- ]length episodes?\b"
CROSS_PROMO_NOTES = r"(?dU)\blisten to (?:episode|the full|.+? on )"


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def sentence_parts(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


FIRST = 16


def first_parts(text: Column) -> Column:
    """The first parts of `sentence_parts`, and behind them what is left, uncut."""
    return F.split(text, SENTENCE_END, FIRST + 1)


def length_score(length: Column) -> Column:
    """Piecewise-linear in the text length, rounded half to even."""
    pieces = " ".join(
        f"WHEN x <= {x1} THEN {y0}D + cast(x - {x0} as double) / {x1 - x0}D * {y1 - y0}D"
        for (x0, y0), (x1, y1) in zip(LENGTH_CURVE, LENGTH_CURVE[1:]))
    return let_sql(length, f"cast(rint(CASE {pieces} ELSE {LENGTH_CURVE[-1][1]}D END) as int)")


def information_density(notes: Column) -> Column:
    """Length curve plus credit for real sentences, list lines and clock times."""

    def real(parts: Column) -> Column:
        return F.size(F.filter(parts, lambda p: p.rlike(TWELVE_LETTERS)))

    def counted(first: Column) -> Column:
        # Nine sentences earn the whole credit: the others are looked at only where the first sixteen hold fewer.
        rest = F.get(first, F.lit(FIRST))
        return let(real(F.slice(first, 1, FIRST)), lambda n: F.when((n >= 9) | rest.isNull(), n).otherwise(n + real(sentence_parts(rest))))

    def density(text: Column) -> Column:
        sentences = let(first_parts(text), counted)
        clocks = F.when(F.contains(text, F.lit(":")), F.regexp_count(text, F.lit(CLOCK_TIME))).otherwise(0)
        marks = F.regexp_count(text, F.lit(BULLET_LINE)) + clocks
        total = length_score(F.length(text)) + F.least(F.lit(25), sentences * 3) + F.least(F.lit(15), marks * 2)
        return F.when(text == "", F.lit(0)).otherwise(F.least(F.lit(100), total))

    return let(strip_html(notes), density)


def topic_relevance(hits: Column, likes: Interests) -> Column:
    return clamp(kw.count_hits(hits, likes.boost) * 8 - kw.count_hits(hits, likes.negative) * 15
                 + kw.count_hits(hits, likes.topics) * 12)


def novelty(low_text: Column, hits: Column, likes: Interests) -> Column:
    people = sum((F.contains(low_text, F.lit(p.lower())).cast("int") for p in likes.people), F.lit(0))
    return clamp(people * 20 + F.when(kw.any_hit(hits, likes.boost[:8]), 15).otherwise(0))


def keyword_dimension(hits: Column, words: tuple[str, ...]) -> Column:
    return clamp(kw.count_hits(hits, words) * 10)


def transcription_value(minutes: Column, notes: Column, hits: Column, strategic_words: tuple[str, ...]) -> Column:
    deep = (F.length(notes) > 200) & notes.rlike(FIVE_ENDS)
    return F.least(F.lit(100), F.when(minutes >= 60, 40).otherwise(0) + F.when(deep, 30).otherwise(0)
                   + F.when(kw.any_hit(hits, strategic_words), 15).otherwise(0))


# Only sums ending in 5 hundredths can tie. There the double is compared with the tie, by an exact split
# product (tie = upper + lower halves of its bits) where both look equal.
_TENTHS = """transform(array(named_struct('total', x.total, 'cents', x.cents, 'tie', cast(x.cents as double) / 100D)), v ->
  transform(array((v.tie * 134217729D) - ((v.tie * 134217729D) - v.tie)), upper ->
    transform(array(if(v.total != v.tie, v.total - v.tie, (upper * 100D - cast(v.cents as double)) + (v.tie - upper) * 100D)), side ->
      cast(floor(v.cents / 10) + cast(pmod(v.cents, 10) > 5 OR (pmod(v.cents, 10) = 5 AND (side > 0 OR (side = 0 AND floor(v.cents / 10) % 2 = 1))) as int) as double) / 10D
    )[0])[0])[0]"""


def tenths(total: Column, hundredths: Column) -> Column:
    """Round a double to one decimal exactly as its binary value demands, half to even.

    `hundredths` is the ideal sum times 100 as an integer.
    """
    return let_sql(F.struct(total.alias("total"), hundredths.alias("cents")), _TENTHS)


def weighted_score() -> Column:
    """Score from the six dimension columns."""
    ideal = " + ".join(f"{n} * {w}" for n, w in WEIGHTS)
    total = " + ".join(f"cast({n} as double) * {w / 100.0!r}D" for n, w in WEIGHTS)
    return tenths(F.expr(f"least(100D, greatest(0D, {total}))"), F.expr(f"least(10000, greatest(0, {ideal}))"))


def score_decision(score: Column, policy: Policy) -> Column:
    return (F.when(score >= policy.full_threshold, "full").when(score >= policy.preview_threshold, "preview")
            .otherwise("skip"))


def full_suggestion(score, transcription, topic, strategic, action, policy: Policy) -> Column:
    off_topic = (topic <= 0) & (F.greatest(strategic, action) < 40)
    return (
        F.when(off_topic, "no")
        .when((score >= policy.yes_score) | (transcription >= policy.yes_transcription), "yes")
        .when((score >= policy.maybe_score) | (transcription >= policy.maybe_transcription), "maybe")
        .otherwise("no")
    )


def scored_words(policy: Policy) -> tuple[str, ...]:
    likes = policy.interests
    every = likes.boost + likes.negative + likes.topics + policy.action_words + policy.strategic_words
    seen: dict[str, str] = {}
    for w in every:
        seen.setdefault(w.lower(), w)
    return tuple(seen.values())


def add_hits(items: DataFrame, policy: Policy) -> DataFrame:
    """Plain title and notes, the lowered text and the matched words (_title, _notes, _low, _hits). Needs episode_title, show_notes."""
    base = items.withColumn("_title", clean_title(F.col("episode_title"))).withColumn(
        "_notes", strip_html(F.col("show_notes")))
    base = base.withColumn("_low", F.lower(F.concat("_title", F.lit(" "), "_notes")))
    return base.withColumn("_hits", kw.matched_words(F.col("_low"), scored_words(policy)))


def add_scores(items: DataFrame, policy: Policy) -> DataFrame:
    """All dimensions, score and score decision in one narrow pass.

    Needs episode_title, show_notes, duration_minutes. The lowered text and the matched words are
    computed once and shared by every dimension.
    """
    likes = policy.interests
    base = add_hits(items, policy)
    hits, notes = F.col("_hits"), F.col("_notes")
    dims = base.withColumns({
        "topic_relevance": topic_relevance(hits, likes),
        "information_density": information_density(notes),
        "novelty": novelty(F.col("_low"), hits, likes),
        "actionability": keyword_dimension(hits, policy.action_words),
        "strategic_value": keyword_dimension(hits, policy.strategic_words),
        "transcription_value": transcription_value(F.col("duration_minutes"), notes, hits, policy.strategic_words),
    })
    scored = dims.withColumn("final_score", weighted_score())
    return scored.withColumn("score_decision", score_decision(F.col("final_score"), policy))


def legacy_score(text: Column, likes: Interests) -> Column:
    """Older 0-10 scale: plain substrings; a negative word caps what came before it at 3."""

    def value(low: Column) -> Column:
        def has(word: str) -> Column:
            return F.contains(low, F.lit(word.lower()))

        out = F.lit(5.0) + sum((F.when(has(w), 0.5).otherwise(0.0) for w in likes.boost), F.lit(0.0))
        if likes.negative:
            bad = reduce(lambda a, b: a | b, [has(w) for w in likes.negative if w])
            out = F.least(out, F.when(bad, F.lit(3.0)))
        out = out + sum((F.when(has(w), 1.0).otherwise(0.0) for w in likes.people + likes.topics), F.lit(0.0))
        return F.least(F.lit(10.0), F.greatest(F.lit(0.0), out))

    return let(F.lower(text), value)


def classify(title: Column, notes: Column, audio_url: Column, seconds: Column, minutes: Column, policy: Policy) -> Column:
    """struct(decision, reason_code, reason_zh); the first rule that applies wins."""
    secs = F.coalesce(seconds, F.lit(0))
    inputs = F.struct(
        F.lower(strip_html(notes)).alias("text"), F.lower(F.coalesce(title, F.lit(""))).alias("title"),
        F.lower(unescape(F.coalesce(audio_url, F.lit("")))).alias("url"),
        F.coalesce(F.nullif(minutes, F.lit(0)), F.floor(secs / 60)).cast("int").alias("minutes"))

    def has(column: Column, words) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w.lower())) for w in words], F.lit(False))

    def verdict(decision: str, code: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(code).alias("reason_code"), F.lit(reason).alias("reason_zh"))

    def first_rule(v: Column) -> Column:
        text, name, url, mins = v["text"], v["title"], v["url"], v["minutes"]
        paid = (F.contains(url, F.lit("paywall")) & has(url, ("intro", "preview", "trailer"))) | (
            F.contains(text, F.lit("subscribe")) & text.rlike(PAYWALL_NOTES))
        promo = F.startswith(strip(name), F.lit("introducing:")) & text.rlike(CROSS_PROMO_NOTES)
        # The codes and sentences of the verdicts.
        return (
            F.when(url == "", verdict("skip", "missing_audio", "缺少可用音频链接，无法进入 Preview。"))
            .when(paid, verdict("skip", "paywall_preview", "当前音频是付费正片的试听或引子，不是完整节目。"))
            .when(promo, verdict("skip", "cross_podcast_promo", "这是导流到其他节目的短推广，不是本播客正片。"))
            .when(has(text, policy.ad_words), verdict("skip", "ad_only", "Show Notes 命中广告或赞助内容规则，按非正片跳过。"))
            .when(has(name, TRAILER_PHRASES),
                  verdict("skip", "trailer_or_announcement", "标题表明这是预告或公告，不是完整节目。"))
            .when(mins < policy.min_minutes,
                  verdict("skip", "below_minimum_duration", f"节目时长低于最低 {policy.min_minutes} 分钟门槛。"))
            .when((strip(name) == "") | ((text == "") & (mins < 5)),
                  verdict("skip", "invalid_metadata", "节目标题或内容元数据不足，无法可靠进入 Preview。"))
            .when(mins < policy.short_minutes,
                  verdict("preview", "valid_short_episode", "有效短节目，保留在 Preview，并在周报中标注短节目。"))
            .otherwise(verdict("preview", "valid_episode", "有效节目，进入 Preview。"))
        )

    return let(inputs, first_rule)
