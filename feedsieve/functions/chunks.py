"""Cutting texts into bounded pieces.

Greedy packing ("as many units as fit") is one anchored regex: the greedy `.{1,max}` takes the
longest run that still ends on a boundary. The cost stays linear in the text and nothing
accumulates, so long documents need no fold and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.text import clean_display_html, strip

# Section headings, protected spans and size limits.
DISPLAY_CHUNK_CHARS = 1200
TRANSLATION_CHUNK_CHARS = 1800
STRUCTURE_HEADINGS = (
    ("resources", r"(?:links?|additional\s+reading|resources?)\s*[:：]?\s*"),
    ("chapters", r"(?:chapters?|timestamps?)\s*[:：]?\s*"),
    ("correction", r"corrections?\b.*"),
    ("disclaimer", r"disclaimers?\b.*"),
)
MARKDOWN_LINK = r"\[[^\]]+\]\(https?://[^)\s]+[^)]*\)"
ADDRESS = r"https?://\S+|www\.\S+"
CLOCK_LINE = r"(?mU)^\s*\(?\d{1,2}:\d{2}(?::\d{2})?\)?"
LIST_LINE = r"(?mU)^\s*(?:[-*]\s+|\d+\.\s+)"
STOPS = "。！？.!?"
# The ranges in front of && settle letters and blanks with two comparisons; they hold all of the set.
STOP = f"[!-?。-？&&[{STOPS}]]"

# Separators that cannot occur in text: between units, and before a heading.
_UNIT = "\x01"
_HARD = "\x02"
_GUARD = "\x03"
_ADDRESS_END = "\x06"
SENTENCE_END = r"(?U)([.!?])\s+"


def _pack(text: Column, limit: int, boundary: str) -> Column:
    """Longest pieces of at most `limit` characters ending on a boundary; an unbreakable run stays whole."""
    pattern = rf"(?sd)\G(.{{1,{limit}}}|.+?)(?:{boundary}|\z)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _paragraphs(text: Column, boundary: str) -> Column:
    return F.filter(F.transform(F.split(text, boundary, -1), strip), lambda p: p != "")


def split_sections(text: Column, limit: int = DISPLAY_CHUNK_CHARS, cleaned: bool = False) -> Column:
    """Display sections: paragraphs, and long ones by sentences or, failing that, by hard slices."""
    body = text if cleaned else clean_display_html(text)

    def pieces(paragraph: Column) -> Column:
        sentence_end = rf"(?<=[{STOPS}])(?![{STOPS}])(?<!\A[{STOPS}])"
        sentences = F.regexp_extract_all(paragraph, F.lit(rf"(?sd).+?{STOP}+|.+\z"), F.lit(0))
        too_long = F.exists(sentences, lambda s: F.length(s) > limit)
        return (
            F.when((F.length(paragraph) <= limit) | ~paragraph.rlike(rf"(?U)[\s{STOPS}]"), F.array(paragraph))
            .when(too_long, F.regexp_extract_all(paragraph, F.lit(rf"(?s).{{1,{limit}}}"), F.lit(0)))
            .otherwise(_pack(paragraph, limit, sentence_end))
        )

    return F.flatten(F.transform(_paragraphs(body, r"\n{2,}"), pieces))


def chunk_structure(text: Column) -> Column:
    """Kind of section a chunk opens with, from its first line; '' for none."""

    def kind_of(first: Column) -> Column:
        out = F.lit("")
        for kind, pattern in reversed(STRUCTURE_HEADINGS):
            out = F.when(first.rlike(rf"(?iUd)\A{pattern}\z"), kind).otherwise(out)
        return out

    return let(strip(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)), kind_of)


# Equal-length masks for what must not count inside a link.
_MASKS = (("://", "\x04\x04\x04"), ("www.", "\x05\x05\x05\x05"))


def _guarded(paragraph: Column) -> Column:
    """Hide blanks after a stop, and address heads, inside links so that links never split."""
    spans = F.regexp_extract_all(paragraph, F.lit(rf"(?U){MARKDOWN_LINK}"), F.lit(0))

    def mask(span: Column) -> Column:
        out = F.regexp_replace(span, r"(?U)(?<=[.!?])\s", _GUARD)
        for plain, hidden in _MASKS:
            out = F.replace(out, F.lit(plain), F.lit(hidden))
        return out

    masked = F.aggregate(spans, paragraph, lambda acc, s: F.replace(acc, s, mask(s)))
    return F.when(F.contains(paragraph, F.lit("](")), masked).otherwise(paragraph)


def _unguarded(text: Column) -> Column:
    out = F.replace(text, F.lit(_GUARD), F.lit(" "))
    for plain, hidden in _MASKS:
        out = F.replace(out, F.lit(hidden), F.lit(plain))
    return out


def _units(paragraph: Column, limit: int) -> Column:
    """Pieces of one over-long paragraph: whole lines of a list or timetable, else whole sentences."""
    by_line = F.contains(paragraph, F.lit("\n")) & (paragraph.rlike(CLOCK_LINE) | paragraph.rlike(LIST_LINE))
    lines = F.array_join(F.filter(F.transform(F.split(paragraph, "\n", -1), strip), lambda x: x != ""), _UNIT)
    # An address runs up to the next blank, so its last full stop ends no sentence.
    linked = F.contains(paragraph, F.lit("://")) | F.contains(paragraph, F.lit("www."))
    marked = F.regexp_replace(_guarded(paragraph), r"(?U)((?:https?://|www\.)\S+)", "$1" + _ADDRESS_END)
    sentences = F.when(linked, F.replace(F.regexp_replace(marked, SENTENCE_END, "$1" + _UNIT), F.lit(_ADDRESS_END), F.lit(""))).otherwise(
        F.regexp_replace(paragraph, SENTENCE_END, "$1" + _UNIT))

    def packed(joined: Column, glue: str) -> Column:
        raw = _pack(joined, limit, _UNIT)
        return F.filter(F.transform(raw, lambda p: strip(F.replace(p, F.lit(_UNIT), F.lit(glue)))),
                        lambda p: p != "")

    return F.when(by_line, packed(lines, "\n")).otherwise(F.transform(packed(sentences, " "), _unguarded))


def pack_chunks(text: Column, limit: int = TRANSLATION_CHUNK_CHARS) -> Column:
    """Translation chunks: paragraphs merged up to the limit; a section heading always opens a new one."""
    limit = limit if limit > 0 else TRANSLATION_CHUNK_CHARS
    body = strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    pieces = F.flatten(F.transform(
        _paragraphs(body, r"(?U)\n\s*\n"),
        lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(_units(p, limit))))
    marked = F.transform(pieces, lambda p, i: F.when(i == 0, p)
                         .when(chunk_structure(p) != "", F.concat(F.lit(_HARD), p))
                         .otherwise(F.concat(F.lit("\n\n"), p)))
    runs = F.split(F.array_join(marked, ""), _HARD, -1)
    chunks = F.flatten(F.transform(runs, lambda r: _pack(r, limit, r"\n\n")))
    return F.filter(F.transform(chunks, strip), lambda c: c != "")
