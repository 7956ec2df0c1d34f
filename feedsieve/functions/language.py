"""Language signals, translation need and completeness of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.text import CJK, clean_display_html, holds_any

# Address patterns ignored when counting letters, and thresholds.
WEB_ADDRESS = r"(?iU)https?://\S+|www\.\S+"
MAIL_ADDRESS = r"(?U)\b[\w.+-]+@[\w.-]+\.\w+\b"
PAREN_CLOCK = r"(?U)\(?\b\d{1,2}:\d{2}(?::\d{2})?\b\)?"
LATIN_WORD = r"(?U)\b[A-Za-z][A-Za-z'-]*\b"
ORIGINAL_RESOURCES = r"(?msdU)^延伸阅读（原文）：\s*$.*"
TERMINAL = r"(?d)[.!?。！？…][\]\)）}\"'’”]*$"
MIN_SIGNAL = 80
SIGNAL = r"\A(?:[^A-Za-z]*+[A-Za-z]){%d}" % MIN_SIGNAL
CHINESE_NAMES = ("zh", "cn", "chinese", "中文")
ENGLISH_NAMES = ("en", "eng", "english")


def _blanked(text: Column, pattern: str, likely: Callable[[Column], Column]) -> Column:
    """Text with a blank in place of each match of a pattern that never spans blanks or line ends.

    Searched are only the words, of the lines, for which `likely` holds, as it must wherever the pattern can match.
    """
    def word(w: Column) -> Column:
        return F.when(likely(w), F.regexp_replace(w, pattern, " ")).otherwise(w)

    def line(x: Column) -> Column:
        return F.when(likely(x), F.array_join(F.transform(F.split(x, " ", -1), word), " ")).otherwise(x)

    return let(text, lambda t: F.when(likely(t), F.array_join(F.transform(F.split(t, "\n", -1), line), "\n")).otherwise(t))


def letter_counts(text: Column) -> Column:
    """struct(cjk, latin) over the display text without addresses; without any cjk, latin counts up to MIN_SIGNAL only, as no rule asks for more."""

    def mailed(part: Column) -> Column:
        return F.contains(part, F.lit("@"))

    def linked(part: Column) -> Column:
        return let(F.lower(part), lambda low: holds_any(low, ("://", "www.")))

    def counts(prose: Column) -> Column:
        # Letters left after deleting every other character: no per-letter match objects.
        latin = F.length(F.regexp_replace(prose, "[^A-Za-z]+", ""))
        return let(F.length(F.regexp_replace(prose, r"[^\x{4e00}-\x{9fff}]+", "")), lambda cjk: F.struct(
            cjk.alias("cjk"), F.when((cjk == 0) & prose.rlike(SIGNAL), MIN_SIGNAL).otherwise(F.least(latin, F.when(cjk == 0, MIN_SIGNAL))).alias("latin")))

    return let(_blanked(_blanked(clean_display_html(text), WEB_ADDRESS, linked), MAIL_ADDRESS, mailed), counts)


def language_of(counts: Column) -> Column:
    def named(v: Column) -> Column:
        cjk, latin = v["cjk"], v["latin"]
        total = cjk + latin
        return (
            F.when(total <= 0, "unknown")
            .when((cjk >= 20) & (cjk / total >= 0.25), "zh")
            .when((latin >= 80) & (latin / total >= 0.65), "en")
            .when(total < MIN_SIGNAL, "unknown")
            .when((cjk >= 10) & (latin >= 40), "mixed")
            .otherwise("unknown")
        )

    return let(counts, named)


def detect_language(text: Column) -> Column:
    return language_of(letter_counts(text))


def needs_translation_from(counts: Column, declared: Column) -> Column:
    said = F.lower(F.trim(F.coalesce(declared, F.lit(""))))

    def needed(v: Column) -> Column:
        cjk, latin = v["cjk"], v["latin"]
        found = language_of(v)
        share = F.coalesce(latin / F.nullif(cjk + latin, F.lit(0)), F.lit(0.0))
        short_english = (latin >= 40) & (cjk < 10) & (share >= 0.75)
        return (
            F.when(said.isin(*CHINESE_NAMES), F.lit(False))
            .when(said.isin(*ENGLISH_NAMES), (found == "en") | (~found.isin("zh", "mixed") & short_english))
            .otherwise(found == "en")
        )

    return let(counts, needed)


def needs_translation(text: Column, declared: Column) -> Column:
    return needs_translation_from(letter_counts(text), declared)


def residual_latin(text: Column) -> Column:
    """How much Latin prose is left in a translated text."""
    body = F.rtrim(F.regexp_replace(clean_display_html(text), ORIGINAL_RESOURCES, ""))
    prose = F.regexp_replace(F.regexp_replace(body, WEB_ADDRESS, " "), PAREN_CLOCK, " ")

    def measured(p: Column) -> Column:
        words = F.regexp_extract_all(p, F.lit(LATIN_WORD), F.lit(0))
        return let(F.struct(
            F.size(words).alias("words"), F.length(F.replace(F.array_join(words, ""), F.lit("'"), F.lit(""))).alias("letters"),
            F.regexp_count(p, F.lit(CJK)).alias("cjk")), judged)

    def judged(v: Column) -> Column:
        ratio = F.coalesce(v["letters"] / F.nullif(v["letters"] + v["cjk"], F.lit(0)), F.lit(0.0))
        return F.struct(
            v["words"].alias("latin_word_count"), v["letters"].alias("latin_character_count"),
            v["cjk"].alias("cjk_character_count"), F.bround(ratio, 4).alias("residual_latin_ratio"),
            ((v["words"] >= 20) & (ratio >= 0.55)).alias("suspected_incomplete_translation"))

    return let(prose, measured)


def source_completeness(source: Column, filtered: Column, truncated: Column, field: Column, reported: Column) -> Column:
    """Evidence that a source text was cut upstream."""
    cut = F.coalesce(truncated, F.lit(False))

    def judged(v: Column) -> Column:
        reasons = F.array_compact(F.array(
            F.when(cut, "upstream_truncated"),
            F.when((v["n"] >= 500) & ~v["ends"], "long_unterminated_source"),
        ))
        return F.struct(
            F.coalesce(F.nullif(field, F.lit("")), F.lit("unknown")).alias("source_field"),
            v["n"].alias("source_length"), F.length(filtered).alias("filtered_length"),
            F.greatest(F.lit(0), F.coalesce(reported, F.lit(0))).alias("reported_source_length"),
            cut.alias("upstream_truncated"), v["ends"].alias("terminal_punctuation_present"),
            (cut | ((v["n"] >= 500) & ~v["ends"])).alias("suspected_source_truncation"), reasons.alias("reasons"))

    return let(F.struct(F.length(source).alias("n"), source.rlike(TERMINAL).alias("ends")), judged)
