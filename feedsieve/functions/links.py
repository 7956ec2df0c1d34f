"""Web addresses and untranslated lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.chunks import chunk_structure
from feedsieve.functions.text import strip

# Address pattern, its trailing punctuation, headings and label words.
ADDRESS = r"(?U)(?:https?://|www\.)[^\s<>'\"]+"
TRAILING = ".,)]），。"
MISSING_HEADING = "原文链接："
RESOURCE_HEADING = "延伸阅读（原文）："
WORD = r"[A-Za-z][A-Za-z0-9'’.-]*"
CLOCK_LABEL = r"(?U)^\(?\d{1,2}:\d{2}(?::\d{2})?\)?\s*(?:[-–—:]\s*)?(.*)$"
PLAIN_LABELS = ("chapter", "chapters", "conclusion", "intro", "introduction", "outro", "sponsor", "sponsors",
                "summary", "welcome")


def extract_urls(text: Column) -> Column:
    """Distinct addresses in order of first occurrence."""
    def found(t: Column) -> Column:
        linked = F.contains(t, F.lit("://")) | F.contains(t, F.lit("www."))
        return F.when(linked, F.regexp_extract_all(t, F.lit(ADDRESS), F.lit(0))).otherwise(F.array().cast("array<string>"))

    raw = let(F.coalesce(text, F.lit("")), found)
    return F.array_distinct(F.filter(F.transform(raw, lambda u: F.rtrim(u, F.lit(TRAILING))), lambda u: u != ""))


def append_urls(urls: Column, output: Column) -> Column:
    """Output text plus a list of those addresses it does not hold."""
    def joined(out: Column) -> Column:
        missing = F.filter(urls, lambda u: ~F.contains(out, u))

        def with_block(lost: Column) -> Column:
            block = F.concat(F.lit(MISSING_HEADING), F.array_join(F.transform(lost, lambda u: F.concat(F.lit("\n- "), u)), ""))
            gap = F.when(out == "", F.lit("")).otherwise(F.lit("\n\n"))
            return F.when(F.size(lost) == 0, out).otherwise(F.concat(out, gap, block))

        return let(missing, with_block)

    return let(strip(F.coalesce(output, F.lit(""))), joined)


def append_missing_urls(source: Column, output: Column) -> Column:
    """Output text plus a list of the source addresses it lost."""
    return append_urls(extract_urls(source), output)


def _entity_label(label: Column) -> Column:
    """A label made only of capitalised words: kept names, except one plain heading word."""

    def kept_name(words: Column) -> Column:
        named = F.forall(words, lambda w: (w != "") & F.left(w, F.lit(1)).rlike("[A-Z]"))
        return (F.size(words) > 0) & named & ((F.size(words) >= 2) | ~F.lower(F.get(words, F.lit(0))).isin(*PLAIN_LABELS))

    return let(F.transform(F.regexp_extract_all(label, F.lit(WORD), F.lit(0)), lambda w: F.btrim(w, F.lit(".'’-—"))), kept_name)


def untranslated_lines(source: Column, output: Column) -> Column:
    """Significant source lines that reappear unchanged in the output."""

    def lines(text: Column) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]", -1), strip),
                        lambda s: s != "")

    def significant(line: Column) -> Column:
        label = F.regexp_extract(line, CLOCK_LABEL, 1)
        timed = line.rlike(CLOCK_LABEL)
        worded = F.regexp_count(line, F.lit(WORD)) >= 4
        only_url = ~F.regexp_replace(line, ADDRESS, "").rlike(WORD)
        return ~only_url & F.when(timed, label.rlike(WORD) & ~_entity_label(label)).otherwise(worded)

    return F.filter(F.array_intersect(lines(source), lines(output)), significant)


def resource_fallback(chunk: Column) -> Column:
    """A resources chunk kept in the original language under its own heading; '' for other chunks."""

    def kept(body: Column) -> Column:
        rest = strip(F.regexp_extract(body, r"(?s)^[^\n]*\n(.*)$", 1))
        headed = F.rtrim(F.concat(F.lit(RESOURCE_HEADING + "\n"), rest), F.lit("\n"))
        return F.when(chunk_structure(body) == "resources", headed).otherwise(F.lit(""))

    return let(strip(F.coalesce(chunk, F.lit(""))), kept)
