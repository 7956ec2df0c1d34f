"""Text cleaning as ordered column expressions (all JVM-side)."""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let, let_sql

# Characters that count as blank when trimming.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Tag, space and newline rules of the two cleaners.
SCRIPT_BLOCK = r"(?is)<(script|style)[^>]*>.*?</\1>"
LINE_BREAK_TAG = r"(?i)<\s*br\s*/?\s*>"
BLOCK_CLOSE = r"(?i)</\s*(p|div|li|ul|ol|h[1-6]|blockquote)\s*>"
BLOCK_OPEN = r"(?i)<\s*(li|p|div|ul|ol|h[1-6]|blockquote)[^>]*>"
DISPLAY_BLOCK_CLOSE = r"(?i)</\s*(p|div|li|h[1-6]|blockquote)\s*>"
DISPLAY_BLOCK_OPEN = r"(?i)<\s*(p|div|li|h[1-6]|blockquote)[^>]*>"
ANY_TAG = r"<[^>]*>"
BROKEN_TAG = r"(?U)<\w+[^<>]*"
GLUED_URL = r"([。！？.!?”\"）)])(?=(?:https?://|www\.))"
# The range in front of && settles letters and plain blanks with one comparison; it holds all of the set.
ODD_SPACES = r"[\r\x{a0}-\x{feff}&&[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}\r]]+"
SPACE_RUN = r"[ \t]{2,}"
SPACES_AROUND_NEWLINE = r" *\n *"
NEWLINE_RUN = r"\n{3,}"
CJK = r"[\x{4e00}-\x{9fff}]"

# The six entities the light stripper knows, in order.
LIGHT_ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&#39;", "'"),
    ("&quot;", '"'),
)

_COMMON_FIRST = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "reg;", "hellip;", "mdash;",
                 "ndash;", "rsquo;", "lsquo;", "rdquo;", "ldquo;", "amp", "lt", "gt", "quot", "nbsp")


def strip(text: Column) -> Column:
    """Trim every kind of blank at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def _entity_names() -> str:
    """The HTML5 entity table as JSON, the frequent names first (map lookups scan in order)."""
    names = html.entities.html5
    ordered = {k: names[k] for k in _COMMON_FIRST} | names
    return json.dumps(ordered).replace("'", "\\u0027")


# Windows-1252 characters of the numeric references 128 to 159.
_HIGH_CONTROLS = "".join(
    bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0))

# What follows an '&' is p. Numeric references become their character; a name is taken whole if known, else by
# its longest known prefix; anything else stays.
_DECODE_NUMBER = rf"""concat(
  transform(array(if(p rlike r'^#[0-9]', cast(right(concat('0', regexp_extract(p, r'^#([0-9]+)', 1)), 18) as bigint),
                     cast(conv(right(regexp_extract(p, r'^#[xX]([0-9a-fA-F]+)', 1), 15), 16, 10) as bigint))), c -> CASE
    WHEN c = 0 OR c BETWEEN 55296 AND 57343 OR c > 1114111 THEN '\ufffd'
    WHEN c BETWEEN 128 AND 159 THEN substring('{"".join(f"{chr(92)}u{ord(ch):04x}" for ch in _HIGH_CONTROLS)}', cast(c - 127 as int), 1)
    WHEN c BETWEEN 1 AND 8 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR (c & 65534) = 65534 THEN ''
    ELSE decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') END)[0],
  regexp_replace(p, r'^#(?:[0-9]+|[xX][0-9a-fA-F]+);?', ''))"""
_DECODE_NAME = r"""transform(array(regexp_extract(p, r'^[^\t\n\f <&#;]{1,32};?', 0)), n -> CASE
    WHEN length(n) < 2 THEN concat('&', p)
    WHEN try_element_at(names, n) IS NOT NULL THEN concat(try_element_at(names, n), substring(p, length(n) + 1))
    ELSE coalesce(get(filter(transform(sequence(length(n), 2, -1), k -> concat(try_element_at(names, substring(n, 1, k)), substring(p, k + 1))), v -> v IS NOT NULL), 0), concat('&', p)) END)[0]"""


def unescape(text: Column) -> Column:
    """HTML5 entity decoding; text without '&' passes through untouched."""
    one = f"if(p rlike r'^#(?:[0-9]|[xX][0-9a-fA-F])', {_DECODE_NUMBER}, {_DECODE_NAME})"
    decoded = (f"transform(array(from_json(r'{_entity_names()}', 'map<string,string>')), names -> transform(array(split(x, '&', -1)), parts -> "
               f"concat(parts[0], array_join(transform(slice(parts, 2, size(parts)), p -> {one}), '')))[0])[0]")
    return let_sql(text, f"CASE WHEN contains(x, '&') THEN {decoded} ELSE x END")


def holds_any(text: Column, words) -> Column:
    """Whether a text holds one of some plain texts."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def replaced(text: Column, rules) -> Column:
    """Replacements one by one. The plain texts of a rule are those without which its pattern changes nothing; they cost less to look for."""
    def applied(pattern: str, replacement: str, *needed: str) -> Column:
        if not needed:
            return F.regexp_replace(text, pattern, replacement)
        return let(text, lambda t: F.when(holds_any(t, needed), F.regexp_replace(t, pattern, replacement)).otherwise(t))

    for rule in rules:
        text = applied(*rule)
    return text


TIDY_LINES = ((SPACE_RUN, " ", "  ", "\t"), (SPACES_AROUND_NEWLINE, "\n", " \n", "\n "), (NEWLINE_RUN, "\n\n", "\n\n\n"))
_TIDY = ((ODD_SPACES, " "), *TIDY_LINES)


def _to_plain(text: Column, tag_rules, tidy_rules) -> Column:
    """Decode, turn markup into text (only where there is markup), then tidy blanks."""

    def without_markup(body: Column) -> Column:
        return F.when(F.contains(body, F.lit("<")), replaced(body, tag_rules)).otherwise(body)

    def without_signs(body: Column) -> Column:
        return F.when(holds_any(body, "<>"), F.translate(body, "<>", "")).otherwise(body)

    plain = let(let(unescape(F.coalesce(text, F.lit(""))), without_markup), without_signs)
    return strip(replaced(plain, tidy_rules))


def clean_html(text: Column) -> Column:
    """Markup to plain text with line structure kept; inline tags become a space."""
    return _to_plain(text, ((SCRIPT_BLOCK, " "), (LINE_BREAK_TAG, "\n"), (BLOCK_CLOSE, "\n"), (BLOCK_OPEN, "\n"),
                            (ANY_TAG, " "), (BROKEN_TAG, " ")), ((GLUED_URL, "$1 ", "://", "www."),) + _TIDY)


def clean_display_html(text: Column) -> Column:
    """Display variant: opening block tags and inline tags vanish instead of becoming blanks."""
    return _to_plain(text, ((SCRIPT_BLOCK, ""), (LINE_BREAK_TAG, "\n"), (DISPLAY_BLOCK_CLOSE, "\n"),
                            (DISPLAY_BLOCK_OPEN, ""), (ANY_TAG, "")), _TIDY)


def strip_html(text: Column) -> Column:
    """Tags out, six entities decoded, ends trimmed."""
    def without_tags(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, "<[^>]+>", "")).otherwise(t)

    def decoded(t: Column) -> Column:
        out = t
        for entity, char in LIGHT_ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return strip(let(let(F.coalesce(text, F.lit("")), without_tags), decoded))


def clean_title(text: Column) -> Column:
    """Title for display: entities decoded, dangling end quotes off, blanks collapsed."""
    out = F.rtrim(unescape(F.coalesce(text, F.lit(""))), F.lit("\"'"))
    return strip(F.regexp_replace(out, " {2,}", " "))


def clean_block_title(text: Column) -> Column:
    """Title inside document blocks: every quote removed."""
    out = F.translate(unescape(F.coalesce(text, F.lit(""))), "\"'", "")
    return strip(F.regexp_replace(out, " {2,}", " "))


def collapse_blanks(text: Column) -> Column:
    # Single plain blanks, the common case, are left alone.
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))



def best_display_text(notes_text, notes, description, summary_items, one_liner) -> Column:
    """Display text of an item: notes fields, then joined summary lines, then the one-liner."""
    lines = F.filter(F.transform(F.coalesce(summary_items, F.array().cast("array<string>")), clean_display_html),
                     lambda s: s != "")
    joined = F.nullif(F.array_join(lines, "\n"), F.lit(""))
    direct = [let(clean_display_html(c), lambda t: F.when(t != "", t)) for c in (notes_text, notes, description)]
    return F.coalesce(*direct, joined, clean_display_html(one_liner))


MARKS = ("\x01\x02", "\x03\x04", "\x05\x06")  # opening and closing signs around a name in a text
_SIGNS = "".join(MARKS)
NAME_START = rf"(?<!\w[{_SIGNS}]{{0,6}})"
NAME_END = rf"[{_SIGNS}]*"


def marked_name(signs: str = MARKS[0]) -> str:
    """Pattern of a name that `mark` has put between the signs."""
    return f"{signs[0]}[^{signs}]*{signs[1]}"


def unmarked(text: Column) -> Column:
    return F.translate(text, _SIGNS, "")


def mark(text: Column, name: Column, signs: str = MARKS[0], same_case: bool = False) -> Column:
    """The text with signs around each occurrence of a name, upper and lower case alike unless `same_case`.

    Later patterns look for the signs, so no pattern is made from data.
    """
    around = F.concat(F.lit(signs[0]), name, F.lit(signs[1]))
    if same_case:
        return F.when(F.length(name) > 0, F.replace(text, name, around)).otherwise(text)

    def cut(t: Column) -> Column:
        # Pieces between the names, taken from the original by their lengths in the lower-case text.
        pieces = F.split(F.replace(F.lower(t), F.lower(name), F.lit(signs[0])), signs[0], -1)
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
        walked = F.aggregate(pieces, start, lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + F.length(name)).alias("at"),
            F.concat(acc["out"], F.array(F.substring(t, acc["at"], F.length(p)), F.lit(signs[0]), F.substring(t, acc["at"] + F.length(p), F.length(name)), F.lit(signs[1]))).alias("out")))
        whole = F.array_join(F.slice(walked["out"], 1, F.size(walked["out"]) - 3), "")
        even = (F.length(F.lower(t)) == F.length(t)) & (F.length(F.lower(name)) == F.length(name))
        return F.when(even, whole).otherwise(F.replace(t, name, around))

    return let(text, lambda t: F.when(F.length(name) > 0, cut(t)).otherwise(t))
