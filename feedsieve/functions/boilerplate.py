"""Boilerplate removal inside a text.

Each line (or block) is first reduced to one letter naming its kind; the rules that depend on what
came before ("lines after a sponsor line", "blocks below a header") are then plain regex rewrites of
that short letter string. Everything stays in one row, in linear time, without Python.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.text import TIDY_LINES, clean_display_html, holds_any, replaced, strip

# Line patterns, all on the lowercased line.
BOILERPLATE_LINES = (
    r"learn more about your ad choices",
    r"podcastchoices\.com/adchoices",
    r"hosted by simplecast",
    r"adswizz",
    r"pcm\.adswizz\.com",
    r"for more details please see a16z\.com/disclosures",
    r"^stay updated:",
    r"find a16z on youtube",
    r"listen to the a16z show on spotify",
    r"^perplexity:\s*download the app or ask perplexity",
    r"download the app or ask perplexity",
    r"bluechew",
    r"use code rogan",
    r"promo code rogan",
    r"draftkings",
    r"dkng\.co/rogan",
    r"armra\.com/rogan",
    r"visible\.com",
    r"visible\+ pro",
    r"betterhelp\.com/jre",
    r"chime\.com/rogan",
    r"open an account in minutes at",
    r"ziprecruiter\.com/rogan",
    r"thefarmersdog\.com/rogan",
    r"wildpastures\.com/rogan",
    r"^become a colossus member\b",
    r"ramp\.com/invest",
    r"vanta\.com/invest",
    r"\bworkos is infrastructure for b2b and ai-native companies\b",
    r"\bworkos.*\binfrastructure\b.*\bsell to enterprise\b",
    r"^learn more about workos\b",
    r"workos\.com",
    r"rogo\.ai/invest",
    r"ridgeline\.ai",
    r"\bthe podcast consultant\b",
    r"^find a16z on x\b",
    r"^find a16z on linkedin\b",
    r"^listen to the a16z (?:show|podcast) on apple podcasts\b",
    r"^follow our host:",
    r"^only bloomberg\.com subscribers\b",
    r"^subscribe to the odd lots newsletter\b",
    r"^join the conversation:\s*discord\.gg/oddlots\b",
    r"omnystudio\.com/listener",
    r"^subscribe to the verge to access the ad-free version of decoder\b",
    r"^decoder is a production of the verge\b",
    r"^subscribe today at nytimes\.com/podcasts\b",
    r"^this is a public episode\b.*www\.volts\.wtf/subscribe",
    r"^sponsor of chat with traders podcast:",
    r"^trade the pool:",
    r"^trading disclaimer:",
    r"trading in the financial markets involves a risk of loss",
    r"do not constitute trading or investment recommendations or advice",
)
CHINESE_THANKS = r"感谢.*对本期节目的赞助播出"
SPONSOR_LINES = (
    r"\bthis episode is sponsored by\b",
    r"\bthis episode is brought to you by\b",
    r"\bthis video is sponsored by\b",
    r"\bbrought to you by\b",
    r"\bsponsored by\b",
    r"\bthanks to our sponsor\b",
    r"\bthanks to our sponsors\b",
    r"\bour sponsor\b",
    r"\bour sponsors\b",
    r"\buse code\b",
    r"\bpromo code\b",
    r"\bcoupon code\b",
    r"\badvertising partner\b",
    CHINESE_THANKS,
)
SPONSOR_HEADERS = (r"^sponsors?:?$", r"^our sponsors?:?$")
SPONSOR_FOLLOW_UPS = (
    r"^learn more\b",
    r"^learn more at\b",
    r"^visit\b",
    r"^sign up\b",
    r"^check out\b",
    r"^get started\b",
    r"^use code\b",
    r"^promo code\b",
    r"^go to\b",
    r"^subscribe\b",
    r"^关于这款\b",
    r"^如果你对.*感兴趣",
)
CONTENT_HEADERS = (
    r"^outline:?$",
    r"^timestamps?:?$",
    r"^chapters?:?$",
    r"^resources?:?$",
    r"^links(?:\s*\+\s*resources)?:?$",
    r"^read more:?$",
    r"^本期内容相关资料",
    r"^📁\s*本期内容相关资料",
)
LIST_ITEM = r"^(?:[*\-•]\s+|\d+[.)]\s+)"
WHOLE_TEXT_NOTICES = (
    r"(?is)please note that the content here is for informational purposes only.*?"
    r"(?:for more details please see\s+)?a16z\.com/disclosures\.?",
    r"(?is)a16z and its affiliates may maintain investments.*?a16z\.com/disclosures\.?",
    r"(?is)learn more about your ad choices\.?\s*(?:visit\s+)?podcastchoices\.com/adchoices\.?",
)
NOTICE_LITERALS = ("a16z.com/disclosures", "podcastchoices.com/adchoices")

# Block patterns. Headers are matched on the first line, markers near the block start.
SECTION_HEADERS = {
    "resources": (
        r"^(?:resources?|links(?:\s*\+\s*resources)?|additional reading|related reading|read more)\s*[:：]?\s*$",
        r"^(?:本期内容相关资料|相关资料|延伸阅读|资料链接)[:：]?$",
    ),
    "chapters": (
        r"^(?:chapters?|timestamps?|timecodes?|outline)\s*[:：]?\s*$",
        r"^(?:章节|时间轴|时间戳)[:：]?$",
    ),
    "credits": (
        r"^(?:credits?|production credits?):?$",
        r"^(?:制作团队|制作人员|制作名单)[:：]?$",
    ),
    "cta": (
        r"^(?:stay updated|follow us|contact us|subscribe|learn more):?$",
        r"^(?:关注我们|联系我们|订阅|了解更多)[:：]?$",
    ),
    "sponsor": (
        r"^(?:sponsors?|our sponsors?):?$",
        r"^(?:赞助|本期赞助)[:：]?$",
    ),
}
BLOCK_MARKERS = {
    "privacy": (
        r"\bprivacy policy\b",
        r"\bcalifornia privacy notice\b",
        r"\bprivacy information\b",
        r"learn more about your ad choices",
        r"podcastchoices\.com/adchoices",
        r"hosted by simplecast",
        r"\badswizz\b",
        r"a16z\.com/disclosures",
    ),
    "sponsor": (
        r"\bthis (?:episode|video) is sponsored by\b",
        r"\b(?:this episode is )?brought to you by\b",
        r"\bthanks to our sponsors?\b",
        r"\bto support this podcast\b.*\bsponsors?\b",
        r"\bpromo code\b",
        r"\buse code\b",
        r"\bdraftkings\b",
        r"\bbetterhelp\b",
        r"\bget watch party snacks and groceries on uber eats\b",
        r"\bonx offroad:\s*try onx offroad\b",
        r"\btry alex\b.*\btryalex\.",
        r"感谢.*对本期节目的赞助播出",
    ),
    "cta": (
        r"^live long and prosper[.!]?$",
        r"\bwe want to hear from you\b.*\bemail us\b",
        r"\bfind [^\n.]+ on youtube and tiktok\b",
        r"\bget full access to .*?(?:subscribe|subscription)",
        r"\bmaking sense podcast logo\b.*\bsubscribe\b",
        r"\bsubscribe today at\b",
        r"\bsubscribe to the mailing list\b",
        r"\baccess transcript with premium membership\b",
        r"\bfollow ted on\b",
        r"\bonly bloomberg\.com subscribers\b",
        r"\bsubscribe to the odd lots newsletter\b",
        r"\bsubscribe to the verge\b",
        r"欢迎关注.*公众号",
        r"加入知识星球",
    ),
    "credits": (
        r"^credits?:",
        r"\bproduced (?:and edited )?by\b.*\bedited by\b",
        r"\boriginal music (?:and engineering )?by\b",
        r"\bthe .* music is by\b",
        r"\bediting and post-production work .* provided by\b",
    ),
}
MARKER_REACH = 120
SPONSOR_ITEM = r"^[A-Z][A-Za-z0-9&.+\- ]{1,40}:\s+\S"
SPONSOR_CONTINUES = r"^(?:learn more|visit|sign up|check out|get started|use code|promo code|go to)\b"
CTA_CONTINUES = r"^(?:find|follow|listen|subscribe|email|join|download|访问|关注|订阅|加入)\b"
CREDITS_CONTINUES = r"\b(?:produced|edited|music|engineering|post-production|executive editor)\b"


# One part of a pattern: an escape, a set, an opening or closing bracket, a bar, an anchor, or a character; and what repeats it.
_PART = re.compile(r"(?P<one>\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:<?[=!]|[a-zA-Z:-]*[:)]|P?<\w+>))?|[)|^$.]|[^\\\[(){}?*+|^$.])(?P<times>[?*+]|\{[\d,]*\})?\??", re.S)


def needed_literal(pattern: str) -> str:
    """Longest plain text every match of a pattern must contain: characters outside brackets that are neither optional nor repeated."""
    best = run = ""
    depth = 0
    for m in _PART.finditer(pattern):
        one, times = m["one"], m["times"]
        if one.startswith("(") and one.endswith(")"):
            continue  # flags
        depth += one.startswith("(") - (one == ")")
        if one == "|" and depth == 0:
            return ""
        if depth or one == ")" or one in (r"\b", r"\B", "^", "$"):
            run = run if not depth and one != ")" else ""
            continue
        plain = one[1] if re.fullmatch(r"\\[^a-zA-Z0-9]", one) else one if len(one) == 1 and one != "." else ""
        if plain and times is None:
            run += plain
        else:
            run = ""
        best = max(best, run, key=len)
    return best


def _any(patterns, flags: str = "dU") -> str:
    return f"(?{flags})(?:" + "|".join(patterns) + ")"


def _start(patterns, flags: str = "dU") -> str:
    """Alternatives that all begin at the start: one shared anchor, so no other position is tried."""
    return f"(?{flags})^(?:" + "|".join(p.removeprefix("^") for p in patterns) + ")"


def _literals(patterns) -> list[str]:
    literals = sorted({needed_literal(p) for p in patterns}, key=len)
    return [w for i, w in enumerate(literals) if not any(v in w for v in literals[:i])]


def _mentions(low_text: Column, patterns) -> Column:
    """Cheap test that some pattern could match at all."""
    return F.exists(F.lit(_literals(patterns)), lambda w: F.contains(low_text, w))


def _shared(literals: list[str]) -> list[str]:
    """Fewer texts, of which each of some texts holds one: what most of them share, again and again; the others as they are."""
    left, out = list(literals), []
    while True:
        parts = Counter(p for w in left for p in {w[i:j] for i in range(len(w)) for j in range(i + 4, len(w) + 1) if " " not in w[i:j]})
        best = max(parts, key=lambda p: (parts[p], len(p), p), default="")
        if parts[best] < 2:
            return out + left
        out.append(best)
        left = [w for w in left if best not in w]


def _hinted(text: Column, patterns) -> Column:
    """Cheaper test than `_mentions` for whole texts of any case; it may hold where no pattern can match."""
    return let(F.lower(text), lambda low: holds_any(low, _shared(_literals(patterns))))


def _split_anchored(patterns) -> tuple[list[str], list[str]]:
    return [p for p in patterns if p.startswith("^")], [p for p in patterns if not p.startswith("^")]


def line_letters(lines: Column) -> Column:
    """One letter per line.

    B blank, T content header, X boilerplate, H sponsor header; the rest W/V sponsor line (three or
    two follow-ups), C follow-up, O other, in lower case for list items.
    """
    junk_start, junk_inside = _split_anchored(BOILERPLATE_LINES)

    def letter(line: Column) -> Column:
        inputs = F.struct(line.alias("line"), F.lower(line).alias("low"))
        return F.when(line == "", "B").otherwise(let(inputs, lambda v: let(
            _mentions(v["low"], tuple(junk_inside) + SPONSOR_LINES), lambda costly: ranked(v["line"], v["low"], costly))))

    def ranked(line: Column, low: Column, costly: Column) -> Column:
        kind = (F.when(costly & low.rlike(CHINESE_THANKS), "V").when(costly & low.rlike(_any(SPONSOR_LINES)), "W")
                .when(low.rlike(_start(SPONSOR_FOLLOW_UPS)), "C").otherwise("O"))
        return (
            F.when(low.rlike(_start(CONTENT_HEADERS)), "T")
            .when(low.rlike(_start(junk_start)) | (costly & low.rlike(_any(junk_inside))), "X")
            .when(low.rlike(_start(SPONSOR_HEADERS)), "H")
            .otherwise(let(kind, lambda k: F.when(line.rlike(rf"(?U){LIST_ITEM}"), F.lower(k)).otherwise(k)))
        )

    return F.array_join(F.transform(lines, letter), "")


def dropped_lines(letters: Column) -> Column:
    """Letter string with every removed line turned into 'd' or 'X'."""
    out = F.regexp_replace(letters, r"H|(?!^)\G[BXwvco]", "d")  # below a sponsor header: list items and blanks
    out = F.translate(out, "WwVv", "ttuu")
    for now, left in (("t", "u"), ("u", "n"), ("n", "d")):  # follow-ups use up the allowance one by one
        out = F.regexp_replace(out, rf"{now}([BX]*)[Cc]", rf"d$1{left}")
    return F.translate(out, "tun", "ddd")


def _without_notices(body: Column) -> Column:
    trimmed = body
    for pattern in WHOLE_TEXT_NOTICES:
        trimmed = F.regexp_replace(trimmed, pattern, "")
    return F.when(let(F.lower(body), lambda low: holds_any(low, NOTICE_LITERALS)), trimmed).otherwise(body)


def _kept_lines(body: Column) -> Column:
    def joined(lines: Column) -> Column:
        # Only lines of these patterns drop lines, themselves or others.
        every = BOILERPLATE_LINES + SPONSOR_LINES + SPONSOR_HEADERS
        return F.when(_hinted(body, every), kept_of(lines)).otherwise(F.array_join(lines, "\n"))

    def kept_of(lines: Column) -> Column:
        marks = F.split(dropped_lines(line_letters(lines)), "", -1)
        zipped = F.arrays_zip(lines.alias("line"), marks.alias("mark"))
        kept = F.filter(zipped, lambda z: z["mark"].isin("T", "B", "C", "c", "O", "o"))
        return F.array_join(F.transform(kept, lambda z: z["line"]), "\n")

    out = let(F.transform(F.split(body, r"[\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]", -1), strip), joined)
    return strip(replaced(out, TIDY_LINES))


def filter_lines(text: Column, cleaned: bool = False) -> Column:
    """Text without boilerplate and sponsor lines."""
    body = text if cleaned else clean_display_html(text)
    return let(let(body, _without_notices), lambda b: F.when(b == "", F.lit("")).otherwise(_kept_lines(b)))


_HEADER_LETTER = {"resources": "R", "chapters": "C", "credits": "E", "cta": "A", "sponsor": "S"}
_MARKERS = tuple(p for patterns in BLOCK_MARKERS.values() for p in patterns)
_MARKER_LETTER = {"privacy": "p", "sponsor": "s", "cta": "a", "credits": "e"}
# letter -> (category, removal reason or '')
LETTER_MEANING = {
    "R": ("resources", ""), "r": ("resources", ""), "C": ("chapters", ""), "c": ("chapters", ""),
    "E": ("credits", "credits_section"), "z": ("credits", "credits_section"),
    "A": ("cta", "cta_section"), "y": ("cta", "cta_section"),
    "S": ("sponsor", "sponsor_section"), "x": ("sponsor", "sponsor_section"),
    "p": ("privacy", "privacy_marker"), "s": ("sponsor", "sponsor_marker"),
    "a": ("cta", "cta_marker"), "e": ("credits", "credits_marker"),
    **{str(n): ("body", "") for n in range(8)},
}
_KEPT = "[RrCc0-7]"


def block_letters(blocks: Column, hinted: Column | None = None) -> Column:
    """One letter per block: section header, removal marker, or a digit holding three continuation bits.

    `hinted`: whether the text could hold a marker at all, where that is known.
    """
    every = _MARKERS

    def letter(block: Column) -> Column:
        inputs = F.struct(block.alias("block"), F.lower(block).alias("low"), F.lower(strip(F.substring_index(block, "\n", 1))).alias("first"))
        return let(inputs, lambda v: let(_mentions(v["first"], every) if hinted is None else hinted & _mentions(v["first"], every), lambda costly: ranked(v["block"], v["low"], v["first"], costly)))

    def ranked(block: Column, low: Column, first: Column, costly: Column) -> Column:
        out = F.when(F.lit(False), "0")
        for name, patterns in SECTION_HEADERS.items():
            out = out.when(first.rlike(_start(patterns)), _HEADER_LETTER[name])
        for name, patterns in BLOCK_MARKERS.items():
            near = rf"(?sU)\A.{{0,{MARKER_REACH}}}?" + "(?:" + "|".join(patterns) + ")"
            out = out.when(costly & first.rlike(near), _MARKER_LETTER[name])
        sponsor = block.rlike(rf"(?U){LIST_ITEM}") | block.rlike(rf"(?U){SPONSOR_ITEM}") | low.rlike(rf"(?U){SPONSOR_CONTINUES}")
        bits = (sponsor.cast("int") + low.rlike(rf"(?U){CTA_CONTINUES}").cast("int") * 2
                + low.rlike(rf"(?U){CREDITS_CONTINUES}").cast("int") * 4)
        return out.otherwise(bits.cast("string"))

    return F.array_join(F.transform(blocks, letter), "")


def carried_sections(letters: Column) -> Column:
    """Spread each header's section over the blocks below it; marked blocks neither join nor end one."""
    out = letters
    for header, joins, mark in (("S", "[1357]", "x"), ("A", "[2367]", "y"), ("E", "[4567]", "z"),
                                ("R", "[0-7]", "r"), ("C", "[0-7]", "c")):
        out = F.regexp_replace(out, rf"((?:{header}|(?!^)\G)[psae]*){joins}", rf"$1{mark}")
    return out


def _counts(letters: Column, removed: bool, changed: Column | None = None) -> Column:
    """Non-zero block counts per category; a text the line filter changed counts once more as sponsor."""
    names: dict[str, str] = {}
    for ch, (category, reason) in LETTER_MEANING.items():
        if bool(reason) == removed:
            names[category] = names.get(category, "") + ch


    def count(name: str, chars: str) -> Column:
        n = F.regexp_count(letters, F.lit(f"[{chars}]"))
        return n + changed.cast("int") if name == "sponsor" and changed is not None else n

    entries = [F.struct(F.lit(n).alias("key"), count(n, chars).alias("value")) for n, chars in names.items()]
    return F.filter(F.array(*entries), lambda e: e["value"] > 0)


def filter_blocks(text: Column, separator: str = r"(?U)\n\s*\n", cleaned: bool = False) -> Column:
    """struct(text, kept_category_counts, removed_category_counts, removed_reasons) of a display text."""

    def judged(body: Column) -> Column:
        blocks = F.filter(F.transform(F.split(body, separator, -1), strip), lambda b: b != "")
        return let(blocks, lambda bs: let(_hinted(body, _MARKERS), lambda hinted: let(
            carried_sections(block_letters(bs, hinted)), lambda letters: kept(bs, letters))))

    def kept(blocks: Column, letters: Column) -> Column:
        zipped = F.arrays_zip(blocks.alias("block"), F.split(letters, "", -1).alias("mark"))
        held = F.filter(zipped, lambda z: z["mark"].rlike(_KEPT))
        kept_text = F.array_join(F.transform(held, lambda z: z["block"]), "\n\n")
        return let(kept_text, lambda t: let(filter_lines(t), lambda final: result(letters, final, final != t)))

    def result(letters: Column, final: Column, changed: Column) -> Column:
        marks = F.split(letters, "", -1)
        reasons = F.array_distinct(F.filter(F.transform(marks, _reason), lambda r: r != ""))
        late = F.when(changed, F.array(F.lit("legacy_line_filter"))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            final.alias("text"),
            F.map_from_entries(_counts(letters, False)).alias("kept_category_counts"),
            F.map_from_entries(_counts(letters, True, changed)).alias("removed_category_counts"),
            F.concat(reasons, late).alias("removed_reasons"))

    return let(text if cleaned else clean_display_html(text), judged)


def _reason(mark: Column) -> Column:
    out = F.lit("")
    for reason in sorted({r for _, r in LETTER_MEANING.values() if r}):
        chars = [c for c, (_, r) in LETTER_MEANING.items() if r == reason]
        out = F.when(mark.isin(*chars), reason).otherwise(out)
    return out
