"""Guest names: candidates from a pattern table, cleaning, exclusion, status and background.

All patterns run in one pass over the rows; texts that lack a pattern's required words skip it. What
follows works on the short candidate rows only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions.bind import let, let_sql, raw
from feedsieve.functions.boilerplate import needed_literal
from feedsieve.functions.text import holds_any, mark, marked_name, strip, unescape, unmarked
from feedsieve.operators.joins import expand_alias, with_host_flag
from feedsieve.session import materialize

# ---- Fixed values: the pattern table (name patterns and their labels, in order). ----
_EN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"
_EN_LOOSE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
_ZH_TAIL = r"([^，。、；!?\n]{2,30})"
_EN_TAIL = r"([^,\n。]{2,40})"
_ZH_ROLES = r"(?:创始人兼CEO|创始人|CEO|投资人|合伙人)"
_EN_ROLES = r"(?:economists?|Substack writer|writer|author|trader|researcher)"
ALIAS_PATTERNS = (
    (r"(?:[\x{4e00}-\x{9fff}A-Za-z0-9&. ]{0,40}(?:嘉宾|工程师|创始人|CEO|投资人|合伙人)\s*)?"
     r"([\x{4e00}-\x{9fff}]{2,4})\s*[（(]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\s*[）)]", "chinese_name_english_alias"),
)
ROLE_ZH_PATTERNS = (
    (r"(?:本期(?:对话)?的?嘉宾是|嘉宾是)(?:我的好朋友)?(?:[\x{4e00}-\x{9fff}A-Za-z0-9&. ]{1,30}的)?" + _ZH_ROLES +
     r"\s*([\x{4e00}-\x{9fff}]{2,4})(?=[。；，,、\s]|$|他|她|是)", "chinese_role_before_name"),
    (r"(?:本期(?:对话)?的?嘉宾是|嘉宾是)(?:我的好朋友)?\s*([\x{4e00}-\x{9fff}]{2,4})(?=[。；，,、\s]|$|他|她|是)", "chinese_guest_intro_name"),
    (r"(?:本期嘉宾|本期对话嘉宾)\s*([\x{4e00}-\x{9fff}]{2,4})(?=是|，|。|$)", "chinese_guest_intro_name"),
)
ZH_PATTERNS = (
    (r"本期请到\s*" + _ZH_TAIL, "本期请到"),
    (r"本期邀请\s*" + _ZH_TAIL, "本期邀请"),
    (r"我们邀请了\s*" + _ZH_TAIL, "我们邀请了"),
    (r"本期嘉宾[：:]\s*" + _ZH_TAIL, "本期嘉宾"),
    (r"嘉宾[：:]\s*" + _ZH_TAIL, "嘉宾"),
    (r"特邀嘉宾\s*" + _ZH_TAIL, "特邀嘉宾"),
    (r"访谈嘉宾\s*" + _ZH_TAIL, "访谈嘉宾"),
    (r"对谈嘉宾\s*" + _ZH_TAIL, "对谈嘉宾"),
)
ZH_WEAK_PATTERNS = (
    (r"主播对话\s*" + _ZH_TAIL, "主播对话"),
    (r"邀请\s*" + _ZH_TAIL + r"\s*(?:来做客|来聊|来对谈|参加)", "邀请来做客"),
    (r"和\s*" + _ZH_TAIL + r"\s*聊", "和XXX聊"),
    (r"跟\s*" + _ZH_TAIL + r"\s*聊", "跟XXX聊"),
    (r"与\s*" + _ZH_TAIL + r"\s*(?:对谈|访谈|交流)", "与XXX对谈"),
    (_ZH_TAIL + r"\s*做客", "XXX做客"),
    (_ZH_TAIL + r"\s*来做客", "XXX来做客"),
    (r"嘉宾是\s*" + _ZH_TAIL, "嘉宾是"),
)
EN_PATTERNS = (
    (r"\bguest\s*:\s*" + _EN_TAIL, "guest_colon"),
    (r"\bfeaturing\s+guest\s+" + _EN_TAIL, "featuring_guest"),
    (r"\bjoined\s+by\s+" + _EN_TAIL, "joined_by"),
    (r"\bin\s+conversation\s+with\s+" + _EN_TAIL, "in_conversation_with"),
    (r"\ba\s+conversation\s+with\s+" + _EN_TAIL, "a_conversation_with"),
    (r"\btalks?\s+with\s+" + _EN_TAIL, "talks_with"),
    (r"\bspeaks?\s+with\s+" + _EN_TAIL, "speaks_with"),
    (r"\binterview\s+with\s+" + _EN_TAIL, "interview_with"),
)
EN_WEAK_PATTERNS = (
    (r"\btalking\s+to\s+" + _EN_TAIL, "talking_to"),
    (r"\bwith\s+(" + _EN + r")\b", "with_pattern"),
    (r"\bfeaturing\s+(" + _EN + r")\b", "featuring_pattern"),
    (r"\b(" + _EN_LOOSE + r")\s+joins\s+(" + _EN_LOOSE + r")\s+(?:for|to|today|on)", "guest_joins"),
)
IS_A_PATTERNS = ((r"^(" + _EN_LOOSE + r")\s+(?:is|was|are)\s+(?:a|an|the)\s+", "desc_is_a"),)
CREDENTIAL_PATTERNS = ((r"(?:^|\n)(" + _EN + r"),\s+(?:Ph\.?D\.?|MD|MBA|CFA),\s+is\b", "desc_credentialed_is"),)
ROLE_EN_PATTERNS = (
    (r"\b(?:[A-Z][A-Za-z0-9&.-]{1,30}\s+)?(?:co-founder|cofounder|founder)\s+and\s+CEO\s+(" + _EN + r")\b", "english_role_before_name"),
    (r"\b(?:[A-Z][A-Za-z0-9&.-]{1,30}\s+)?(?:founder|researcher|writer|author|trader)\s+(" + _EN + r")\b", "english_role_before_name"),
    (r"\b" + _EN_ROLES + r"(?:\s+and\s+" + _EN_ROLES + r")*\s+(" + _EN + r")\b", "english_role_before_name"),
)
PAIR_PATTERNS = (
    (r"\b(?:speaks?|talks?)\s+with\s+(" + _EN + r"),\s+[^,\n]{2,120},\s+and\s+(" + _EN + r"),\s+[^,\n]{2,120}(?=,|\.)",
     "english_appositive_multi_guest"),
    (r"\b(?:(?:speaks?|talks?)\s+with|interviews)\s+(?:economists?|analysts?|investors?|founders?|researchers?|writers?|authors?)\s+("
     + _EN + r")\s+and\s+(" + _EN + r")\b", "english_coordinated_multi_guest"),
    (r"\b(" + _EN + r")\s+and\s+(" + _EN + r")\s+(?:team\s+up|discuss|talk\s+about|explain|join)\b", "english_bare_coordinated_multi_guest"),
)
SPEAKER_PATTERNS = (
    (r"(" + _EN_LOOSE + r"),\s+[^,]+,\s+and\s+(" + _EN_LOOSE + r"),\s+[^,]+,\s+(?:discuss|talk|explain|share)", "description_multi_speaker"),
)
ZH_CONTEXT_PATTERNS = (
    (r"[——~…]{1,2}\s*([A-Z][a-zA-Z]{1,30}(?:\s+[A-Za-z]{1,20}){0,2})(?=[，,，\s]|$)", "dash_name"),
    (r"[先](?:先)?\s*介绍[一下]*[：:—~-]*\s*([A-Z][a-zA-Z]{1,30}(?:\s+[A-Za-z]{1,20}){0,2})(?=[，,，\s]|$)", "intro_name"),
    (r"([A-Z][a-zA-Z]{1,30}(?:\s+[A-Za-z]{1,20}){0,2})(?:在|是|为|氏)\s*[^，。、；!?\n]{2,40}", "zh_name_desc"),
    (r"[🎤🎧🎙️]\s*(?:本期嘉宾\s*)?([A-Za-z\x{4e00}-\x{9fff}]{2,20})(?=[@，,，\s]|$)", "emoji_guest"),
    (r"本期嘉宾\s*([A-Za-z\x{4e00}-\x{9fff}]{2,20})(?=[@，,，\s]|$)", "benqi_guoke"),
)
# Cheap conditions every match of the costly patterns implies; texts that fail them skip the pattern.
GUARDS = {
    "chinese_name_english_alias": r"[\x{4e00}-\x{9fff}]\s*[（(]\s*[A-Z]",
    "description_multi_speaker": r"(?iU),\s+(?:discuss|talk|explain|share)",
    "english_role_before_name": r"(?:founder|researcher|[wW]riter|author|trader|economist)",
    "english_coordinated_multi_guest": r"(?U)(?:with|interviews)\s+(?:economist|analyst|investor|founder|researcher|writer|author)",
    "english_bare_coordinated_multi_guest": r"(?U)[a-z]\s+(?:team\s+up|discuss|talk\s+about|explain|join)\b",
    "zh_name_desc": r"[a-zA-Z](?:在|是|为|氏)",
    "emoji_guest": r"[🎤🎧🎙️]",
    "dash_name": r"(?U)[——~…]\s*[A-Z]",
}
# Plain texts of which every match holds one, looked for before the guard.
LITERALS = {
    "chinese_name_english_alias": ("（", "("),
    "chinese_role_before_name": ("嘉宾是",),
    "chinese_guest_intro_name": ("嘉宾",),
    "english_role_before_name": ("founder", "researcher", "riter", "author", "trader", "economist"),
    "english_bare_coordinated_multi_guest": ("team", "discuss", "talk", "explain", "join"),
    "zh_name_desc": ("在", "是", "为", "氏"),
    "emoji_guest": ("🎤", "🎧", "🎙", "\ufe0f"),
    "dash_name": ("—", "~", "…"),
}
INTRO_SIGNALS = ("——", "~", "…", "先介绍", "请到", "邀请", "嘉宾", "来做客")
ENTITY_EXEMPT = ("本期嘉宾", "嘉宾", "特邀嘉宾", "访谈嘉宾")
TITLE_PATTERNS = (
    (r"^JRE\s+MMA\s+Show\s+#(\d+)\s+with\s+([^&]+?)(?:\s+&\s+(.+))?$", "title_jre_mma"),
    (r"^[^-\x{ff0d}–—]*[-–—]\s*[\s\S]*?[-–—]\s+([A-Z][a-z]+(?:\s+[A-Z]\.?[a-z]+)?)\s*$", "title_lex_format"),
    (r"^[-–—]\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\s*$", "title_dash_guest"),
    (r"^(\d+)\.\s*(?:对)?([\x{4e00}-\x{9fff}]{2,4})(?:的|之)", "title_cn_num_name"),
)
TITLE_NAME_OF = r"^\d+\.\s*([A-Za-z]{2,30}?)\s*的"

# ---- Fixed values: name lists. ----
TITLE_ENTITIES = (
    "frida", "frida kahlo", "kahlo", "gaudi", "gauguin", "van gogh", "monet", "picasso", "dali", "dalí", "warhol", "okeeffe",
    "kandinsky", "matisse", "rembrandt", "michelangelo", "lego",
    "freda", "fred", "john", "jane", "alice", "bob", "mike", "tom", "jack", "lucy", "sarah", "emma", "oliver", "david", "sophie",
    "apple", "google", "meta", "amazon", "tesla", "nvidia", "openai", "microsoft", "facebook", "twitter", "x corp",
    "capital", "principles", "war", "peace", "genesis", "odin",
)
BAD_NAMES = (
    "trailer", "preview", "announcement", "full episode", "episode info", "show info", "subscribe", "intro", "outro", "opening",
    "closing", "ad ", "advertisement", "sponsored", "bonus", "omnibus",
)
BAD_EXACT = ("她多次", "他多次", "它多次")
STOP_NAMES = ("the", "a", "an", "of", "and", "or", "but", "in", "on", "at", "to", "for", "with", "about", "from")
NOISE_NAMES = (
    "author", "authors", "ceo", "co-founder", "cofounder", "code rogan", "promo code rogan", "rogan", "draftkings", "analyst",
    "analysts", "economist", "economists", "founder", "founders", "investor", "investors", "betterhelp", "visible", "visible+ pro",
    "armra", "bluechew", "chime", "perplexity", "researcher", "researchers", "trade the pool", "trader", "traders", "writer", "writers",
)
ROLE_PREFIXES = (
    "tech analyst", "analysts", "analyst", "economists", "economist", "investors", "investor", "founders", "founder", "researchers",
    "researcher", "substack writer", "writers", "writer", "traders", "trader", "authors", "author",
)
ALIASES = (("雨森", "戴雨森"), ("小鹏", "何小鹏"), ("马斯克", "埃隆·马斯克"), ("佩奇", "拉里·佩奇"), ("布林", "谢尔盖·布林"))
# Reason by family (by pattern for the families "plain" and "title") and decision; {name} and {pattern} are filled in.
REASONS = {
    "alias/confirmed_guest": "中文姓名 + 英文别名格式识别为嘉宾",
    "role_zh/confirmed_guest": "中文 role-before-name / 嘉宾介绍句识别为嘉宾",
    "zh/rejected_host": "'{name}'是已知主播，跳过",
    "zh/mentioned_entity": "'{name}'是历史人物/标题实体，不是嘉宾",
    "zh/confirmed_guest": "匹配中文嘉宾短语「{pattern}」",
    "zh_weak/rejected_host": "'{name}'是已知主播",
    "zh_weak/possible_guest": "匹配「{pattern}」，但需要描述上下文确认",
    "en/rejected_host": "'{name}'是已知主播，跳过",
    "en/mentioned_entity": "'{name}'是标题实体/历史人物",
    "en/confirmed_guest": "匹配英文嘉宾短语「{pattern}」",
    "en_weak/confirmed_guest": "匹配「{pattern}」+描述确认",
    "en_weak/possible_guest": "匹配「{pattern}」但需描述确认",
    "desc_is_a/confirmed_guest": "描述格式「Name is a...」识别为嘉宾",
    "desc_credentialed_is/confirmed_guest": "描述格式「Name, credentials, is...」识别为嘉宾",
    "english_role_before_name/confirmed_guest": "英文 role-before-name 格式识别为嘉宾",
    "english_appositive_multi_guest/confirmed_guest": "英文 appositive multi-guest 格式识别为嘉宾",
    "english_coordinated_multi_guest/confirmed_guest": "英文 coordinated multi-guest 格式识别为嘉宾",
    "english_bare_coordinated_multi_guest/confirmed_guest": "英文 bare coordinated multi-guest 格式识别为嘉宾",
    "description_multi_speaker/confirmed_guest": "描述 multi-speaker 格式识别为嘉宾",
    "zh_context/confirmed_guest": "中文描述格式「{pattern}」识别为嘉宾",
    "zh_context/possible_guest": "匹配中文描述「{pattern}」，需进一步确认",
    "feed/confirmed_guest": "来自 feed guests/contributors 字段",
    "title_jre_mma/confirmed_guest": "标题 JRE MMA 格式识别为嘉宾",
    "title_lex_format/confirmed_guest": "标题 Lex Fridman 格式识别为嘉宾",
    "title_dash_guest/confirmed_guest": "标题明确嘉宾格式「{pattern}」",
    "title_cn_num_name/confirmed_guest": "标题中文数字.名字格式识别为嘉宾",
}
SHORT_FOR = "（{short}为{name}的简称）"
ONLY_MENTIONED = "标题出现'{name}'但无明确嘉宾标记"
NOTHING_FOUND = "元数据中未发现明确嘉宾标记"
DECISION_RANK = {"confirmed_guest": 4, "possible_guest": 3, "mentioned_entity": 2, "rejected_host": 1}


@dataclass(frozen=True)
class Family:
    """Patterns that share their flags and the rule that turns a name into a decision."""

    name: str
    patterns: tuple
    flags: str = "mdU"
    groups: int = 1
    cut: int = 100
    before: int = 0  # characters of context kept before the match
    after: int = 0  # and after it


FAMILIES = (
    Family("alias", ALIAS_PATTERNS),
    Family("role_zh", ROLE_ZH_PATTERNS),
    Family("zh", ZH_PATTERNS),
    Family("zh_weak", ZH_WEAK_PATTERNS),
    Family("en", EN_PATTERNS, "imdU"),
    Family("en_weak", EN_WEAK_PATTERNS, "imdU", before=20, after=100),
    Family("plain", IS_A_PATTERNS),
    Family("plain", CREDENTIAL_PATTERNS, "imdU"),
    Family("plain", ROLE_EN_PATTERNS, cut=120),
    Family("plain", PAIR_PATTERNS, "dU", groups=2, cut=150),
    Family("plain", SPEAKER_PATTERNS, "idU", groups=2, cut=150),
    Family("zh_context", ZH_CONTEXT_PATTERNS, before=30),
)
CANDIDATE = "array<struct<pattern_no:int,source_no:int,match_no:int,family:string,source:string,pattern:string,raw:string,matched_text:string,context:string>>"


# First of the Chinese, full-width and pictorial signs.
FAR = "\u2e80"
# Signs around a match and between its groups.
MATCH, FIELD = "\x01", "\x02"


def _uncaptured(pattern: str) -> str:
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def _matches(family: Family, pattern: str, label: str, number: int, source: str, source_no: int, tested: bool = False) -> str:
    """SQL over the text x: candidate structs of one pattern; `tested`: what its label asks of a text is known to hold."""
    flags = f"(?{family.flags})"
    full, offset = pattern, 0
    if family.before:
        # Zero-width captures of the surroundings, tried only where the pattern itself matches.
        left = rf"(?:(?<=([\s\S]{{{family.before}}}))|(?<=\A([\s\S]{{0,{family.before - 1}}})))"
        full, offset = f"(?={_uncaptured(pattern)}){left}{pattern}", 2
    n_groups = offset + len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    if family.after:
        full += rf"(?=([\s\S]{{0,{family.after}}}))"

    # The pattern runs once: each match is replaced by itself and its groups between signs, and cut out there.
    groups = [0, *range(offset + 1, offset + family.groups + 1)]
    context = [1, 2] if family.before else []
    if family.before or family.after:
        context.append(0)
    if family.after:
        context.append(n_groups + 1)
    groups += [g for g in context if g not in groups]
    signed = MATCH + FIELD.join(f"${g}" for g in groups) + MATCH
    marked = f"regexp_replace(x, {raw(flags + full)}, '{signed}')"
    fields = f"transform(filter(split(marked, '{MATCH}', -1), (p, i) -> i % 2 = 1), p -> split(p, '{FIELD}', -1))"

    def field(g: int) -> str:
        return f"m[{groups.index(g)}]"

    shown = f"concat({', '.join(field(g) for g in context)})" if context else "''"
    structs = ", ".join(
        f"named_struct('pattern_no', {number}, 'source_no', {source_no}, 'match_no', i * {family.groups} + {g}, 'family', '{family.name}', 'source', '{source}', "
        f"'pattern', '{label}', 'raw', {field(offset + g)}, 'matched_text', left({field(0)}, {family.cut}), 'context', {shown})" for g in range(1, family.groups + 1))
    found = f"transform(array({marked}), marked -> flatten(transform({fields}, (m, i) -> array({structs}))))[0]"
    literal = _literal(pattern)
    return _where(([f"contains(low, {raw(literal)})"] if literal else []) + ([] if tested else _tests(label)), found)


def _literal(pattern: str) -> str:
    return needed_literal(re.sub(r"\\x\{[0-9a-f]+\}", ".", pattern)).lower()


def _tests(label: str) -> list[str]:
    tests = []
    if label in LITERALS:
        tests.append("(" + " OR ".join(f"contains(x, {raw(one)})" for one in LITERALS[label]) + ")")
    if label in GUARDS:
        tests.append(f"x rlike {raw(GUARDS[label])}")
    return tests


def _where(tests: list[str], found: str) -> str:
    return f"if({' AND '.join(tests)}, {found}, array())" if tests else found


def _text_candidates(text: Column, source: str, source_no: int) -> Column:
    found, number = [], 0
    for family in FAMILIES:
        for label, patterns in groupby(family.patterns, key=itemgetter(1)):
            of_label = [pattern for pattern, _ in patterns]
            matches = [_matches(family, pattern, label, number + i, source, source_no, tested=True) for i, pattern in enumerate(of_label)]
            number += len(matches)
            # One look for signs of the far scripts spares most texts all patterns that need them; then what patterns of one label share.
            far = all(any(ch >= FAR for ch in one) for one in LITERALS.get(label, map(_literal, of_label)))
            found.append(_where((["far"] if far else []) + _tests(label), matches[0] if len(matches) == 1 else f"concat({', '.join(matches)})"))
    every = f"transform(array(lower(x)), low -> transform(array(x rlike {raw(f'[{FAR}-{chr(0x10ffff)}]')}), far -> concat({', '.join(found)}))[0])[0]"
    # The text's own signs become blanks.
    whole = F.coalesce(text, F.lit(""))
    return let_sql(F.when(holds_any(whole, MATCH + FIELD), F.translate(whole, MATCH + FIELD, "  ")).otherwise(whole), every).cast(CANDIDATE)


def _title_candidates(title: Column) -> Column:
    def every(t: Column) -> Column:
        def one(number: int, label: str, name: Column, pattern: str) -> Column:
            return F.when(t.rlike(f"(?dU){pattern}"), F.struct(
                F.lit(900 + number).alias("pattern_no"), F.lit(8).alias("source_no"), F.lit(number).alias("match_no"), F.lit("title").alias("family"),
                F.lit("title").alias("source"), F.lit(label).alias("pattern"), name.alias("raw"), F.left(t, F.lit(100)).alias("matched_text"),
                F.lit("").alias("context")))

        mma, lex, dash, numbered = TITLE_PATTERNS

        def part(pattern: str, i: int) -> Column:
            return F.regexp_extract(t, f"(?dU){pattern}", i)

        def quoted(i: int) -> Column:
            return strip(F.btrim(strip(part(mma[0], i)), F.lit('"')))

        second = one(1, mma[1], quoted(3), mma[0])
        return F.array_compact(F.array(
            one(0, mma[1], quoted(2), mma[0]), F.when(part(mma[0], 3) != "", second),
            one(2, lex[1], strip(part(lex[0], 1)), lex[0]), one(3, dash[1], strip(part(dash[0], 1)), dash[0]),
            one(4, numbered[1], part(numbered[0], 2), numbered[0])))

    return let(strip(unescape(F.coalesce(title, F.lit("")))), every)


def _feed_candidates(guests: Column) -> Column:
    kept = F.filter(F.coalesce(guests, F.array().cast("array<struct<name:string,role:string>>")), lambda g: (
        ~F.coalesce(g["role"], F.lit("")).isin("host", "anchor", "presenter")) & (strip(F.coalesce(g["name"], F.lit(""))) != ""))
    return F.transform(kept, lambda g, i: F.struct(
        F.lit(800).alias("pattern_no"), F.lit(7).alias("source_no"), i.alias("match_no"), F.lit("feed").alias("family"),
        F.lit("feed_metadata").alias("source"), F.lit("feed_guest").alias("pattern"), strip(g["name"]).alias("raw"),
        F.left(g["name"], F.lit(80)).alias("matched_text"), F.lit("").alias("context")))


def clean_guest_name(found: Column) -> Column:
    """A candidate without what clings to it: joined second names, topics, punctuation, quotes, roles."""
    out = strip(F.regexp_replace(F.coalesce(found, F.lit("")), r"(?U)\s+", " "))
    for pattern in (r"(?iU)\s+and\s+\S.*$", r"(?U)\s+&\s+\S.*$", r"(?iU)\s+about\s+\S.*$"):
        out = F.regexp_replace(out, pattern, "")
    out = strip(F.translate(F.rtrim(out, F.lit(".,;:")), "\"'", ""))
    prefixes = "|".join(re.escape(p).replace(r"\ ", " ") for p in ROLE_PREFIXES)

    def without_role(name: Column) -> Column:
        zh = name
        for pattern in (r"^我的好朋友([\x{4e00}-\x{9fff}]{2,4})$",
                        r"^(?:[\x{4e00}-\x{9fff}A-Za-z0-9&. ]{1,30}的)?" + _ZH_ROLES + r"([\x{4e00}-\x{9fff}]{2,4})$",
                        r"^嘉宾是([\x{4e00}-\x{9fff}]{2,4})$"):
            zh = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(zh)
        en = F.regexp_replace(name, rf"(?iU)^(?:{prefixes})\s+([A-Z][A-Z]*(?:\s+[A-Z][A-Z]*){{0,2}})$", "$1")
        return F.when(name.rlike(r"[\x{4e00}-\x{9fff}]"), zh).otherwise(en)

    return let(F.regexp_replace(out, r"(?U)\s+", " "), without_role)


def name_noise(name: Column) -> Column:
    """Not a person's name: wrong length, known non-names, numbers, times, stop words."""
    def judged(n: Column) -> Column:
        low = F.lower(n)
        words = F.filter(F.split(low, r"(?U)\s+", -1), lambda w: w != "")
        return (
            (F.length(n) < 2) | (F.length(n) > 60) | low.isin(*BAD_NAMES) | n.rlike(r"(?U)^[\d.,/#\s\[\]\(\){}【】（）]+$")
            | low.rlike(r"(?U)^(episode|ep|part|pt)\s*\d+") | n.rlike(r"(?U)^\d{1,2}:\d{2}") | n.isin(*BAD_EXACT)
            | ((F.size(words) <= 2) & F.forall(words, lambda w: w.isin(*STOP_NAMES))))

    return let(strip(F.coalesce(name, F.lit(""))), judged)


def known_noise(name: Column) -> Column:
    flat = F.lower(strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " ")))
    return (flat == "") | flat.isin(*NOISE_NAMES)


def title_entity(name: Column, entities=TITLE_ENTITIES) -> Column:
    return F.lower(strip(name)).isin(*entities)


def reason(family: Column, pattern: Column, decision: Column, name: Column) -> Column:
    """Why a candidate got its decision, from the fixed values of `REASONS`."""
    kind = F.when(family.isin("plain", "title"), pattern).otherwise(family)
    reasons = F.create_map(*[F.lit(v) for pair in REASONS.items() for v in pair])
    template = F.element_at(reasons, F.concat(kind, F.lit("/"), decision))
    return F.replace(F.replace(template, F.lit("{pattern}"), pattern), F.lit("{name}"), name)


def evidence_text(evidence: Column) -> Column:
    """Evidence as one line: "[source/pattern] reason" of each, in order."""
    return F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("["), e["source"], F.lit("/"), e["pattern"], F.lit("] "), e["reason"])), " | ")


def raw_candidates(items: DataFrame, key: str = "item_pos") -> DataFrame:
    """Every pattern match as a row. Needs podcast_name, episode_title, show_notes; description and guests are optional."""
    parts = [_text_candidates(F.col("show_notes"), "description", 0)]
    if "description" in items.columns:
        parts.append(_text_candidates(F.col("description"), "description", 1))
    if "guests" in items.columns:
        parts.append(_feed_candidates(F.col("guests")))
    parts.append(_title_candidates(F.col("episode_title")))
    return items.select(key, "podcast_name", F.inline(F.concat(*[p.cast(CANDIDATE) for p in parts])))


def guest_candidates(items: DataFrame, hosts: DataFrame, aliases: DataFrame | None = None, key: str = "item_pos") -> DataFrame:
    """Judged candidates: key, seq columns, name, source, pattern, matched_text, decision, reason."""
    # The few matches are stored, so the texts are searched once whatever follows.
    found = materialize(raw_candidates(items, key), "raw-candidates")
    named = found.withColumn("name", clean_guest_name(F.col("raw")))
    kept = named.filter(~name_noise(F.col("name")))
    flagged = with_host_flag(kept, hosts).withColumn("is_entity", title_entity(F.col("name")))
    fam, host, entity = F.col("family"), F.col("is_host"), F.col("is_entity")
    confirmed = mark(unmarked(F.col("context")), F.col("name")).rlike(rf"(?iU){marked_name()}\s+(?:is|was|are)\s+(?:a|an|the)")
    signal = F.col("context").rlike("|".join(INTRO_SIGNALS)) | (F.col("pattern") == "dash_name")
    drop_some = F.startswith(F.col("name"), F.lit("某"))
    cn_title = F.col("pattern") == "title_cn_num_name"
    decision = (
        F.when(fam.isin("alias", "role_zh"), F.when(~drop_some & ~host & ~entity, "confirmed_guest"))
        .when(fam.isin("zh", "en"), F.when(host, "rejected_host").when(entity & ~F.col("pattern").isin(*ENTITY_EXEMPT), "mentioned_entity").otherwise("confirmed_guest"))
        .when(fam == "zh_weak", F.when(host, "rejected_host").otherwise("possible_guest"))
        .when(fam == "en_weak", F.when(~host, F.when(confirmed, "confirmed_guest").otherwise("possible_guest")))
        .when(fam == "plain", F.when(~host & ~entity, "confirmed_guest"))
        .when(fam == "zh_context", F.when(~host & ~entity, F.when(signal, "confirmed_guest").otherwise("possible_guest")))
        .when(fam == "feed", "confirmed_guest")
        .otherwise(F.when(~host & (~entity | cn_title), "confirmed_guest")))
    judged = flagged.withColumn("decision", decision).filter(F.col("decision").isNotNull())
    judged = judged.withColumn("reason", reason(fam, F.col("pattern"), F.col("decision"), F.col("name")))
    if aliases is not None:
        texts = items.select(key, F.concat(F.coalesce("show_notes", F.lit("")), F.coalesce(F.col("description"), F.lit("")) if "description" in items.columns else F.lit("")).alias("text"))
        # Only the few candidates from numbered Chinese titles need their item's text again. They are held, the texts pass by: a
        # merge would sort the texts, a broadcast would hold them all.
        grown = expand_alias(judged.filter(cn_title).hint("shuffle_hash").join(texts, key), aliases)
        short = F.replace(F.replace(F.lit(SHORT_FOR), F.lit("{short}"), F.col("name")), F.lit("{name}"), F.col("resolved_name"))
        grown = grown.withColumn("reason", F.concat("reason", F.when(F.col("resolved_name") != F.col("name"), short).otherwise("")))
        judged = judged.filter(~cn_title).unionByName(grown.withColumn("name", F.col("resolved_name")).drop("resolved_name", "text"))
    return judged.drop("family", "raw", "context", "is_host", "is_entity")


def dedup_candidates(candidates: DataFrame, key: str = "item_pos") -> DataFrame:
    """Per item and name the strongest decision, the first among equals; then name fragments are pruned.

    `seq` keeps the place of a name's first occurrence.
    """
    rank = F.lit(0)
    for decision, value in DECISION_RANK.items():
        rank = F.when(F.col("decision") == decision, value).otherwise(rank)
    clean = candidates.filter(~known_noise(F.col("name")))
    order = F.struct("pattern_no", "source_no", "match_no")
    # (item, name) groups are as small as one item's text.
    best = clean.withColumns({"_low": F.lower("name"), "_rank": rank, "_seq": order}).groupBy(key, "_low").agg(
        F.min("_seq").alias("seq"),
        F.min(F.struct(-F.col("_rank"), "_seq", "name", "source", "pattern", "matched_text", "decision", "reason")).alias("b"))
    flat = best.select(key, "seq", "b.name", "b.source", "b.pattern", "b.matched_text", "b.decision", "b.reason")
    # Pruning reads the names four times; stored once, the patterns run once.
    return prune_fragments(materialize(flat, "guest-candidates"), key)


def prune_fragments(candidates: DataFrame, key: str = "item_pos") -> DataFrame:
    """Drop first names whose full name is also there, and Chinese names with a trailing fragment."""
    full = candidates.filter(F.col("name").rlike(r"(?U)^[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)+$")).select(
        key, F.lower(F.substring_index("name", " ", 1)).alias("_first")).distinct()
    single = F.when(F.col("name").rlike("^[A-Z][A-Za-z]+$"), F.lower("name"))
    kept = candidates.withColumn("_first", single).join(full, [key, "_first"], "left_anti").drop("_first")
    whole = candidates.filter(F.col("name").rlike(r"^[\x{4e00}-\x{9fff}]{2,4}$")).select(key, F.col("name").alias("_whole")).distinct()
    # The fragment's possible owners are its own two to four leading characters: an equality join, no pairs.
    tailed = kept.filter(F.contains("name", F.lit("的访"))).withColumn("_whole", F.explode(F.array(*[F.left("name", F.lit(n)) for n in (2, 3, 4)])))
    bad = tailed.join(whole, [key, "_whole"], "left_semi").select(key, "name").distinct()
    return kept.join(bad, [key, "name"], "left_anti")


def guest_status(items: DataFrame, candidates: DataFrame, hosts: DataFrame, key: str = "item_pos") -> DataFrame:
    """Detection status, names and evidence per item from its deduplicated candidates."""
    row = F.struct("seq", "name", "source", "pattern", "matched_text", "decision", "reason")

    def of(decision: str | None) -> Column:
        chosen = row if decision is None else F.when(F.col("decision") == decision, row)
        return F.sort_array(F.collect_list(chosen))

    grouped = candidates.groupBy(key).agg(
        of("confirmed_guest").alias("c"), of("possible_guest").alias("p"), of("mentioned_entity").alias("m"), of(None).alias("every"))
    named = F.regexp_extract("episode_title", f"(?dU){TITLE_NAME_OF}", 1)
    base = items.select(key, "podcast_name", strip(named).alias("name"), F.left("episode_title", F.lit(80)).alias("_title"))
    base = with_host_flag(base, hosts)
    mention = (F.col("name") != "") & ~name_noise(F.col("name")) & ~title_entity(F.col("name")) & ~F.col("is_host")
    out = base.withColumn("_mention", mention).join(grouped, key, "left")
    empty = F.array().cast("array<string>")
    nc, np_, nm = (F.coalesce(F.size(F.col(x)), F.lit(0)) for x in "cpm")
    c0 = F.get("c", F.lit(0))
    pair = r"(?iU)\bwith\s+\S+\s+and\s+[A-Z][a-z]+"
    same = (F.size(F.array_distinct(F.transform("c", lambda x: x["pattern"]))) == 1) & (F.size(F.array_distinct(F.transform("c", lambda x: x["source"]))) == 1)
    team = same & (F.contains(c0["pattern"], F.lit("multi_speaker")) | (c0["pattern"] == "title_jre_mma"))
    status = (
        F.when(F.col("every").isNull() & F.col("_mention"), "mentioned_entity").when(F.col("every").isNull(), "no_guest_detected")
        .when(nc == 1, "confirmed_guest").when((nc > 1) & team, "confirmed_guest").when(nc > 1, "ambiguous")
        .when((np_ == 1) & (nm == 0), "possible_guest").when((nm == 1) & (np_ == 0), "mentioned_entity").otherwise("ambiguous"))
    paired = split_multi_guest(c0["matched_text"], c0["name"])
    names = (
        F.when(F.col("every").isNull() & F.col("_mention"), F.array("name")).when(F.col("every").isNull(), empty)
        .when(nc == 1, F.when(c0["matched_text"].rlike(pair), paired).otherwise(F.array(c0["name"])))
        .when(nc > 1, F.transform("c", lambda x: x["name"]))
        .when((np_ == 1) & (nm == 0), F.transform("p", lambda x: x["name"])).when((nm == 1) & (np_ == 0), F.transform("m", lambda x: x["name"]))
        .otherwise(F.transform(F.slice("every", 1, 3), lambda x: x["name"])))

    def evidence(rows: Column) -> Column:
        return F.transform(rows, lambda x: F.struct(x["name"].alias("name"), x["source"].alias("source"), x["pattern"].alias("pattern"),
                                                    x["matched_text"].alias("matched_text"), x["decision"].alias("decision"), x["reason"].alias("reason")))

    made = F.array(F.struct(F.col("name"), F.lit("title").alias("source"), F.lit("title_name_of").alias("pattern"),
                            F.col("_title").alias("matched_text"), F.lit("mentioned_entity").alias("decision"),
                            F.replace(F.lit(ONLY_MENTIONED), F.lit("{name}"), F.col("name")).alias("reason")))
    nothing = F.array(F.struct(F.lit("").alias("name"), F.lit("none").alias("source"), F.lit("none").alias("pattern"),
                               F.lit("").alias("matched_text"), F.lit("no_guest_detected").alias("decision"), F.lit(NOTHING_FOUND).alias("reason")))
    proof = (
        F.when(F.col("every").isNull() & F.col("_mention"), made).when(F.col("every").isNull(), nothing)
        .when(nc == 1, evidence(F.concat("c", F.slice("p", 1, 1)))).when(nc > 1, evidence(F.slice("c", 1, 3)))
        .otherwise(evidence(F.slice("every", 1, 3))))
    return out.select(key, "podcast_name", status.alias("guest_detection_status"), names.alias("guest_names"), proof.alias("guest_detection_evidence"))


def split_multi_guest(matched: Column, name: Column) -> Column:
    """Names in "with X and Y": the known X and, if it is a name, Y."""
    pattern = F.lit(rf"(?iU)^.*?\bwith\s+{marked_name()}\s+and\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}).*$")

    def both(second: Column) -> Column:
        return F.when((second == "") | name_noise(second), F.array(clean_guest_name(name))).otherwise(F.array(clean_guest_name(name), second))

    found = F.get(F.regexp_extract_all(mark(unmarked(matched), name), pattern, F.lit(1)), F.lit(0))
    return let(clean_guest_name(F.coalesce(found, F.lit(""))), both)
