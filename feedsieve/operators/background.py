"""Guest background: facts around a name, role lists, a sentence, sources and the item roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve import schemas
from feedsieve.functions.bind import let
from feedsieve.functions.items import FALLBACKS, TOPIC_PHRASES, guest_key
from feedsieve.functions.text import MARKS, NAME_END, NAME_START, collapse_blanks, mark, marked_name, strip, unmarked
from feedsieve.operators.guests import name_noise
from feedsieve.operators.joins import cache_ttl_lookup
from feedsieve.operators.quality import quality_label, source_quality
from feedsieve.operators.ranking import top_per_key

# ---- Fixed values: fact labels, patterns and word lists. ----
TITLE_LABEL, ORG_LABEL, FIELD_LABEL, WORK_LABEL = "职务/头衔：", "机构/公司：", "专长/研究：", "著作/案例："
_ZH_TITLES = "合伙人|创始人|CEO|CTO|CFO|COO|VP|董事|基金经理|研究总监|总裁|副总裁|教授|研究员|作家|调查记者|制片人|导演|顾问"
_ZH_ORGS = "资本|基金|投资|集团|公司|研究所|实验室|大学|学院|媒体|出版社|机构"
_EN_ORGS = r"[A-Za-z]{2,20}\s+Capital|Fund|Investment|Group|Ventures|Partners|Horowitz"
_NEAR_TITLES = "基金经理|研究总监|教授|研究员|作家|调查记者|制片人|导演|顾问"
_NAMED_ORG = r"([A-Za-z][A-Za-z0-9\s&]{3,30}(?:\s+[A-Za-z][A-Za-z0-9]{2,15}){0,2})\b"
FACT_TITLES = (
    rf"(?:、|,|\s)([A-Za-z\x{{4e00}}-\x{{9fff}}]{{1,20}}(?:{_ZH_TITLES}))(?:$|[，,，\s])",
    rf"(?:^|\s)([A-Za-z\x{{4e00}}-\x{{9fff}}]{{1,20}}(?:{_ZH_TITLES}))(?:$|[，,，\s])",
    r"\b(co-?founder|founder|co-?creator)\b",
    r"\b(CEO|CTO|CFO|COO|VP|general\s+partner)\b",
    r"\b(author|writer|investor|researcher|scientist|engineer)\b",
)
FACT_ORGS = (
    rf"(?:在|是|为|氏)\s*([A-Za-z\x{{4e00}}-\x{{9fff}}]{{2,30}}?(?:{_ZH_ORGS}))(?:$|[，,，\s]|(?=的))",
    rf"@([A-Za-z\x{{4e00}}-\x{{9fff}}]{{2,30}}?(?:{_ZH_ORGS}))(?:$|[@，,，\s])",
    r"\b([A-Za-z]{1,20}\s+[A-Za-z]{1,20}?\s*(?:Capital|Fund|Investment|Group|Corp|Ventures|Partners|Horowitz))\b",
    rf"({_EN_ORGS})(?=[\s的]|$)",
    rf"(?:是|在|为)\s*([A-Za-z]{{2,30}}\s+Capital|Fund|Investment|Group|Ventures|Partners|Horowitz)\b(?=[\s的])",
    r"(?:co-?founder|founder|CEO|CTO|COO|CFO|VP|president|partner)\s+of\s+([A-Za-z][A-Za-z0-9&]{3,30}(?:\s+[A-Za-z][A-Za-z0-9&]{2,15}){0,2})",
    r"\(([a-z]\d{1,2}[a-z])\)",
)
# (pattern, group of the title or 0, group of the organisation, case-insensitive); the first match of each counts.
FACT_PAIRS = (
    (r"\b(?:is|was)\s+(?:a\s+)?(?:co-?)?founder\s+of\s+" + _NAMED_ORG, 0, 1, True),
    (r"\b(?:is|was)\s+(?:a\s+)?(?:partner|executive|director)\s+(?:at|in|of)\s+" + _NAMED_ORG, 0, 1, True),
    (r"\b(?:is|was)\s+(?:the\s+)?(CEO|CTO|COO|CFO|president|founder|partner)\s+(?:of|at)\s+" + _NAMED_ORG, 1, 2, True),
    (rf"({_EN_ORGS})的(合伙人|创始人)", 2, 1, True),
    (rf"({_EN_ORGS})的(CEO|CTO|COO|CFO)", 2, 1, True),
    (rf"([A-Za-z\x{{4e00}}-\x{{9fff}}]{{2,20}}?基金)({_NEAR_TITLES})", 2, 1, False),
    (rf"([A-Za-z\x{{4e00}}-\x{{9fff}}]{{2,20}}?资本|投资|集团|研究所|实验室)({_NEAR_TITLES})", 2, 1, False),
)
FACT_FIELDS = (
    r"(?:专注|研究|擅长|主攻|从事)\s*([^，。、；!?\n]{4,40})",
    r"(?:研究方向|专长|领域)\s*[：:]\s*([^，。、；!?\n]{4,40})",
)
FACT_WORKS = (
    r"《([^》]{2,30})》",
    r"(?:著作|作品|代表作|作者)\s*[：:]\s*([A-Za-z\x{4e00}-\x{9fff}]{2,40})",
    r"(?:投资案例|代表案例)\s*[：:]\s*([A-Za-z\x{4e00}-\x{9fff}]{2,40})",
    r"\b(Missing\s*\d+)\b",
)
ORG_STOP = (
    "this episode", "the episode", "an episode", "our episode", "today show", "the show", "our show", "the podcast", "new episode",
    "latest episode", "previous episode", "of andreessen", "of horowitz", "of the", "of this",
)
ORG_FRAGMENTS = (
    "capital", "fund", "group", "investment", "investments", "partners", "asset", "assets", "management", "company", "organization")
ORG_TOPICS = TOPIC_PHRASES + ("studying top fund", "top fund managers")
FUND_WORDS = ("Andreessen", "Horowitz", "Capital", "Ventures", "a16Z", "Hugging", "Investment", "Fund")
PAIRED_WORDS = ("Capital", "Fund", "Investment", "Group", "Ventures", "Horowitz", "a16Z", "Hugging")
ROLES_ZH = {
    "comedian": "喜剧演员", "public speaker": "公共演说家", "stand-up comedian": "单口喜剧演员", "actor": "演员", "writer": "作家",
    "retired NFL quarterback": "退役 NFL 四分卫", "sports analyst": "体育评论员", "musician": "音乐人", "bowhunter": "弓猎者",
    "outdoorsman": "户外运动者", "endurance athlete": "耐力运动员", "author": "作者", "entrepreneur": "企业家", "commentator": "评论员",
    "founder": "创始人", "president": "总裁", "president and COO": "总裁兼 COO", "COO": "COO", "CEO": "CEO", "CTO": "CTO", "CFO": "CFO",
    "associate professor": "副教授", "professor": "教授", "director": "主任", "partner": "合伙人", "general partner": "普通合伙人",
    "trader": "交易员", "system designer": "系统设计师", "money manager": "资金管理人", "market strategist": "市场策略师",
    "Chief Scientist": "首席科学家",
}
TITLES_ZH = {
    "co founder": "联合创始人", "cofounder": "联合创始人", "creator": "创始人", "founder": "创始人", "president": "总裁", "coo": "COO",
    "ceo": "CEO", "cto": "CTO", "cfo": "CFO", "president and coo": "总裁兼 COO", "author": "作家", "writer": "作家", "investor": "投资人",
    "researcher": "研究员", "scientist": "科学家", "engineer": "工程师",
}
GENERIC_TITLES = ("作家", "作者", "investor", "researcher", "scientist", "engineer", "founder")
COAUTHOR, COAUTHOR_ZH = "co-author of the new Market Wizards book", "新版 Market Wizards 的合著者"
_LIST_TITLES = (r"President\s+and\s+COO|Founder|CEO|CTO|CFO|COO|President|associate\s+professor|professor|director|partner|general\s+partner")
_LIST_ORG = r"([A-Za-z][A-Za-z0-9&'’ .-]{1,79}?)(?=,|\.|$)"
HOST_OF = r'(?i)host of (?:the\s+)?podcasts?\s+["“]([^"”]+)["”]'
ROLE_BODY_CUTS = (
    r"(?iU)\s+whose\b.*$", r'(?iU)(?:,\s*)?(?:and\s+)?host of (?:the\s+)?podcasts?\s+["“].*$', r"(?iU)(?:,\s*)?(?:and\s+)?co-host\b.*$",
    r'(?iU)(?:,\s*)?(?:and\s+)?author of\s+["“].*$', r"(?iU)^(?:a|an|the)\s+",
)
# Patterns around a guest's name, which stands between signs.
CREDENTIAL = rf"(?dU){NAME_START}{marked_name()},\s*(Ph\.?D\.?|MD|MBA|CFA),\s+is\s+(.+?)\s+at\s+([^.,]+?)(?:,|\.|$)"
STATED = tuple(rf"(?idU){NAME_START}{marked_name()}{join}(?:the|a|an)\s+({_LIST_TITLES})\s+(?:of|at)\s+" + _LIST_ORG for join in (r"\s+is\s+", r",\s+"))
SENTENCE = rf"(?idU)(?:{NAME_START}(?:{'|'.join(marked_name(m) for m in MARKS)}){NAME_END}|He{NAME_END}|She{NAME_END})\s+is{NAME_END}\s+(?:also\s+)?([^.]+)(?:\.|$)"
HELP_MARKS = ("unknown command", "unknown option", "commands:", "display help for command")
MAX_SENTENCE, MAX_BACKGROUND = 150, 300
NO_SOURCES, NO_NAME = FALLBACKS[1], FALLBACKS[2]
NOTES_TITLE = "节目元数据（show_notes）"
CACHED_NOTE, NOTES_ONLY, NOTES_AND_WEB = "来自缓存", "来自节目元数据（show_notes）", "来自节目元数据 + 网络搜索"
NO_SEARCH, WEAK_ONLY, DEGRADED = "搜索失败，无来源", "仅有弱来源（聚合页/标题片段），无法生成可靠背景", "模型生成不可用，降级处理"
NO_GUEST, DISCUSSED, MAYBE, MANY = "未识别到嘉宾", "是节目讨论对象，非本期嘉宾", "可能是嘉宾但证据不足，默认不补", "，同名风险，默认不补"
PROMPT_HEAD, PROMPT_TAIL = "你是一个人物背景研究助手。请根据以下搜索结果，为嘉宾「", "\n\n背景介绍："
PROMPT_BODY = (
    "」生成一段80-150字的中文背景介绍。\n\n要求：\n- 只基于搜索结果总结，不要编造信息\n"
    "- 结构：（1）一句话身份；（2）与本期主题相关的经历/专长；（3）为什么他的背景有助于理解本期讨论\n"
    "- 每位嘉宾背景单独成段，总字数不超过150字\n"
    "- 禁止：夸大形容（\"著名/顶级/权威\"），职务写死但来源不新，私生活八卦\n\n搜索结果：\n")
_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def safe_org(value: Column) -> Column:
    """Organisation text specific enough to show."""
    def judged(v: Column) -> Column:
        low = F.lower(v)
        topical = F.exists(F.array(*[F.lit(t) for t in ORG_TOPICS]), lambda t: F.contains(low, t))
        return (F.length(v).between(2, 80) & ~low.isin(*ORG_FRAGMENTS) & ~low.rlike(r"(?U)^(?:and|or|but|of|with|for|from|in|on|at|the)\b")
                & ~topical & (F.regexp_count(v, F.lit(r"[A-Za-z\x{4e00}-\x{9fff}]")) >= 2))

    flat = F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "), F.lit(" \t\r\n,.;:()[]{}"))
    return let(flat, judged)


def name_context(name: Column, notes: Column, before: int = 100, after: int = 200) -> Column:
    """Surroundings of the first mention of a name, or of its first or last word; null without a mention."""
    def around(v: Column) -> Column:
        low, who = F.lower(v["notes"]), F.lower(v["name"])
        words = F.filter(F.split(who, r"(?U)\s+", -1), lambda w: w != "")
        by_word = F.when(F.size(words) >= 2, F.coalesce(
            F.nullif(F.instr(low, F.get(words, F.lit(0))), F.lit(0)), F.nullif(F.instr(low, F.element_at(words, -1)), F.lit(0))))
        at = F.coalesce(F.nullif(F.instr(low, who), F.lit(0)), by_word)
        return let(at, lambda i: F.when(i.isNotNull() & (who != ""), F.substring(
            v["notes"], F.greatest(i - before, F.lit(1)), i - F.greatest(i - before, F.lit(1)) + after)))

    return let(F.struct(strip(F.coalesce(name, F.lit(""))).alias("name"), F.coalesce(notes, F.lit("")).alias("notes")), around)


def _labelled(values: Column, label: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(label), v))


def _every(context: Column, pattern: str, least: int, flags: str = "idU") -> Column:
    found = F.transform(F.regexp_extract_all(context, F.lit(f"(?{flags}){pattern}"), F.lit(1)), strip)
    return F.filter(found, lambda v: F.length(v) >= least)


def _good_org(v: Column) -> Column:
    return (v != "") & ~name_noise(v) & safe_org(v) & ~F.lower(v).isin(*ORG_STOP)


def facts_around(context: Column) -> Column:
    """Labelled facts of a context, without repeats, in pattern order."""
    def found(c: Column) -> Column:
        parts = [_labelled(_every(c, p, 2), TITLE_LABEL) for p in FACT_TITLES]
        for p in FACT_ORGS:
            good = F.filter(_every(c, p, 1), lambda v: _good_org(v) & ~F.startswith(F.lower(v), F.lit("of ")))
            parts.append(_labelled(F.slice(good, 1, 1), ORG_LABEL))
        for p, title, org, anycase in FACT_PAIRS:
            flags = "(?idU)" if anycase else "(?dU)"

            def at(g: int, p=p, flags=flags) -> Column:
                return strip(F.regexp_extract(c, flags + p, g))

            orgs = let(at(org), lambda v: F.when(_good_org(v), F.array(F.concat(F.lit(ORG_LABEL), v))).otherwise(_none()))
            titles = _none() if not title else let(at(title), lambda v: F.when(F.length(v) >= 2, F.array(
                F.concat(F.lit(TITLE_LABEL), v))).otherwise(_none()))
            parts += [titles, orgs] if title < org else [orgs, titles]
        parts += [_labelled(_every(c, p, 4, "dU"), FIELD_LABEL) for p in FACT_FIELDS]
        parts += [_labelled(_every(c, p, 2), WORK_LABEL) for p in FACT_WORKS]
        return F.array_distinct(F.concat(*parts))

    return let(context, lambda c: F.when(c.isNotNull(), let(c, found)).otherwise(_none()))


def guest_identity(guests: DataFrame) -> DataFrame:
    """Adds `context` and `facts`. Needs guest_name, show_notes."""
    return guests.withColumn("context", name_context(F.col("guest_name"), F.col("show_notes"))).withColumn("facts", facts_around(F.col("context")))


def guest_role_list(guests: DataFrame, text: str = "context") -> DataFrame:
    """Adds `role_info` struct(roles, host_of, org, title, credential, source), null when nothing is said. Needs guest_name."""
    name, body = F.col("guest_name"), F.coalesce(F.col(text), F.lit(""))
    empty = F.lit(None).cast("string")

    def pick(pattern: Column, i: int, source: Column = body) -> Column:
        return F.nullif(strip(F.coalesce(F.get(F.regexp_extract_all(source, pattern, F.lit(i)), F.lit(0)), F.lit(""))), F.lit(""))

    words = F.split(name, r"(?U)\s+", -1)
    several = F.size(words) >= 2
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    # Names are marked in the text, so that the patterns are constant whatever a name holds.
    clear = unmarked(body)
    any_case = mark(clear, name)
    every = F.when(several, mark(mark(any_case, first, MARKS[1]), last, MARKS[2])).otherwise(any_case)
    staged = guests.withColumns({"_exact": mark(clear, name, same_case=True), "_any": any_case, "_every": every})

    def said(source: str, pattern: str, i: int) -> Column:
        return unmarked(pick(F.lit(pattern), i, F.col(source)))

    staged = staged.withColumns({
        "_cred": said("_exact", CREDENTIAL, 1), "_ctitle": said("_exact", CREDENTIAL, 2), "_corg": F.regexp_replace(said("_exact", CREDENTIAL, 3), r"(?iU)^the\s+", ""),
        **{f"_t{i}": said("_any", p, 1) for i, p in enumerate(STATED)}, **{f"_o{i}": said("_any", p, 2) for i, p in enumerate(STATED)}})
    whole, bodies = (F.transform(F.regexp_extract_all("_every", F.lit(SENTENCE), F.lit(i)), unmarked) for i in (0, 1))

    def roles(text_body: Column) -> Column:
        cut = strip(text_body)
        for pattern in ROLE_BODY_CUTS:
            cut = F.regexp_replace(cut, pattern, "")
        parts = F.transform(F.split(strip(cut), r"(?U),\s*|\s+and\s+", -1), lambda p: strip(F.regexp_replace(
            F.regexp_replace(strip(p), r"(?iU)^(?:a|an|the)\s+", ""), r"(?iU)^and\s+", "")))
        return F.filter(parts, lambda r: (r != "") & (F.lower(r) != "host of the podcast"))

    per_sentence = F.transform(F.arrays_zip(whole.alias("w"), bodies.alias("b")), lambda z: F.struct(
        F.lower(z["w"]).rlike(r"^s?he is").alias("pronoun"), roles(z["b"]).alias("roles")))
    # A pronoun sentence counts only after a named one has given a role.
    staged = staged.withColumn("_sent", per_sentence)
    named_at = F.array_min(F.filter(F.transform("_sent", lambda s, i: F.when(~s["pronoun"] & (F.size(s["roles"]) > 0), i)), lambda i: i.isNotNull()))
    staged = staged.withColumn("_from", named_at)
    listed = F.array_distinct(F.flatten(F.filter(F.transform(
        "_sent", lambda s, i: F.when(F.col("_from").isNotNull() & (i >= F.col("_from")), s["roles"])), lambda r: r.isNotNull())))
    staged = staged.withColumn("_roles", listed)
    host = F.nullif(F.rtrim(strip(F.regexp_extract(body, HOST_OF, 1)), F.lit(".,")), F.lit(""))

    def info(role_array: Column, host_of: Column, org: Column, title: Column, cred: Column, source: str) -> Column:
        return F.struct(role_array.alias("roles"), host_of.alias("host_of"), org.alias("org"), title.alias("title"),
                        cred.alias("credential"), F.lit(source).alias("source"))

    out = F.when(F.col("_cred").isNotNull(), info(_none(), empty, F.col("_corg"), F.col("_ctitle"), F.replace("_cred", F.lit("."), F.lit("")),
                                                  "show_notes_credentialed_title_org"))
    for i in (0, 1):
        out = out.when(F.col(f"_o{i}").isNotNull() & safe_org(F.col(f"_o{i}")), info(_none(), empty, F.col(f"_o{i}"), F.col(f"_t{i}"), empty, "show_notes_title_org"))
    out = out.when(F.size("_roles") > 0, info(F.col("_roles"), host, empty, empty, empty, "show_notes_is_a_role_list"))
    return staged.withColumn("role_info", out).drop(*[c for c in staged.columns if c not in guests.columns])


def _dictionary(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])


def role_zh(value: Column) -> Column:
    flat = collapse_blanks(value)
    return F.coalesce(F.try_element_at(_dictionary({k.lower(): v for k, v in ROLES_ZH.items()}), F.lower(flat)), flat)


def role_sentence(name: Column, info: Column) -> Column:
    """Chinese sentence from a role list; '' when a role has no fixed translation."""
    def listed(roles: Column) -> Column:
        known = F.forall(roles, lambda r: (r == COAUTHOR) | r.isin(*ROLES_ZH))
        lead = F.get(roles, F.lit(0)) == COAUTHOR
        rest = F.transform(F.when(lead, F.slice(roles, 2, F.size(roles))).otherwise(roles), role_zh)

        def joined(items: Column) -> Column:
            return F.when(F.size(items) <= 1, F.array_join(items, "")).otherwise(F.concat(
                F.array_join(F.slice(items, 1, F.size(items) - 1), "、"), F.lit("和"), F.element_at(items, -1)))

        def clauses(items: Column) -> Column:
            first = F.when(lead, F.concat(name, F.lit(f" 是{COAUTHOR_ZH}"))).when(F.size(items) > 0, F.concat(name, F.lit(" 是"), joined(items)))
            more = F.when(lead & (F.size(items) > 0), F.concat(F.lit("也是一名"), joined(items)))
            hosting = F.when(info["host_of"].isNotNull(), F.concat(F.lit("也是播客 "), info["host_of"], F.lit(" 的主持人")))
            return F.concat(F.concat_ws("，", first, more, hosting), F.lit("。"))

        return F.when(known & (F.size(roles) > 0), let(rest, clauses)).otherwise("")

    titled = F.concat(name, F.lit(" 是 "), info["org"], F.lit(" 的"), role_zh(info["title"]), F.lit("。"))
    return F.coalesce(F.when(info["title"].isNotNull() & info["org"].isNotNull(), titled).otherwise(let(info["roles"], listed)), F.lit(""))


def _cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def _of_kind(facts: Column, label: str) -> Column:
    kept = F.filter(facts, lambda f: F.startswith(f, F.lit(label)))
    return F.transform(kept, lambda f: F.substring(f, F.lit(len(label) + 1), F.length(f)))


def fact_sentence(name: Column, facts: Column) -> Column:
    """struct(text, confidence) from labelled facts; text is null when they do not suffice."""
    def contains_any(value: Column, words) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(value, w))

    def longest(orgs: Column) -> Column:
        scored = F.transform(orgs, lambda o, i: F.struct(
            F.length(o).alias("n"), contains_any(F.lower(o), [w.lower() for w in FUND_WORDS]).cast("int").alias("fund"), (-i).alias("at"), o.alias("org")))
        return F.coalesce(F.array_max(scored)["org"], F.lit(""))

    def title_key(t: Column) -> Column:
        return F.trim(F.replace(F.lower(t), F.lit("-"), F.lit(" ")))

    def parts(v: Column) -> Column:
        titles, orgs = v["titles"], v["orgs"]
        first = F.get(titles, F.lit(0))
        known = F.coalesce(F.try_element_at(_dictionary(TITLES_ZH), title_key(first)), role_zh(first), F.lit(""))
        mapped = F.exists(titles, lambda t: title_key(t).isin(*TITLES_ZH))
        fund_orgs = F.filter(orgs, lambda o: contains_any(o, PAIRED_WORDS))
        return F.struct(
            longest(orgs).alias("org"), let(longest(fund_orgs), lambda o: F.when(o != "", o).otherwise(longest(orgs))).alias("paired_org"),
            known.alias("title"), ((F.size(fund_orgs) > 0) | ((F.size(orgs) > 0) & mapped)).alias("paired"),
            F.coalesce(F.get(v["fields"], F.lit(0)), F.lit("")).alias("field"))

    def worded(v: Column) -> Column:
        vague = v["title"].isin(*GENERIC_TITLES) & ((v["org"] != "") | (v["field"] != ""))
        return let(F.when(vague, "").otherwise(v["title"]), lambda title: sentence(v, title))

    def sentence(v: Column, title: Column) -> Column:
        org = F.when(v["paired"], v["paired_org"]).otherwise(v["org"])
        base = (
            F.when((org != "") & (title != ""), F.concat(name, F.lit(" 是 "), org, F.lit(" 的"), title))
            .when(org != "", F.concat(name, F.lit(" 任职于 "), org))
            .when((title != "") & v["paired"], F.concat(name, F.lit(" 是"), title))
            .when(title != "", F.lit(FALLBACKS[0])))
        focus = F.concat(F.lit("专注"), v["field"])
        text = (
            F.when(v["field"] == "", base).when(base.isNull(), F.concat(name, focus))
            .when(base == FALLBACKS[0], F.concat(name, base, focus)).otherwise(F.concat(base, F.lit("，"), focus)))
        ended = F.when(text.rlike(r"(?:[。！？]|\.\.\.)$"), text).otherwise(F.concat(text, F.lit("。")))
        found = (v["org"] != "").cast("int") + (title != "").cast("int") + (v["field"] != "").cast("int")
        return F.struct(_cut(ended, MAX_SENTENCE).alias("text"), F.when(found >= 2, "medium").otherwise("low").alias("confidence"))

    kinds = F.struct(_of_kind(facts, TITLE_LABEL).alias("titles"), _of_kind(facts, ORG_LABEL).alias("orgs"), _of_kind(facts, FIELD_LABEL).alias("fields"))
    return let(let(kinds, parts), worded)


def guest_sentence(guests: DataFrame) -> DataFrame:
    """Adds background_zh and confidence from role list and facts; null where the notes say too little."""
    roled = guest_role_list(guests) if "role_info" not in guests.columns else guests
    said = roled.withColumns({"_role": F.when(F.size("facts") > 0, role_sentence(F.col("guest_name"), F.col("role_info"))),
                              "_fact": F.when(F.size("facts") > 0, fact_sentence(F.col("guest_name"), F.col("facts")))})
    has_role = F.coalesce("_role", F.lit("")) != ""
    return said.withColumns({
        "background_zh": F.when(has_role, _cut(F.col("_role"), MAX_SENTENCE)).otherwise(F.col("_fact.text")),
        "confidence": F.when(has_role, "medium").when(F.col("_fact.text").isNotNull(), F.col("_fact.confidence")),
    }).drop("_role", "_fact")


def search_queries(guests: DataFrame) -> DataFrame:
    """Two query texts per guest."""
    return guests.select("guest_name", F.posexplode(F.array(
        F.concat("guest_name", F.lit(" 嘉宾 简介 背景")), F.concat("guest_name", F.lit(" biography profile")))).alias("query_no", "query"))


def search_result_rows(landed: DataFrame, keep: int = 5) -> DataFrame:
    """Rows of landed search answers (JSON with `results`, `items`, or a plain list); help texts and bad JSON give none."""
    low = F.lower(F.coalesce("body", F.lit("")))
    usable = ~low.rlike("|".join(HELP_MARKS))
    named = F.from_json(F.when(usable, F.col("body")), f"struct<results:{schemas.SEARCH_ITEM},items:{schemas.SEARCH_ITEM}>")
    plain = F.from_json(F.when(usable & low.rlike(r"^\s*\["), F.col("body")), schemas.SEARCH_ITEM)
    rows = F.coalesce(plain, named["results"], named["items"])
    keys = [c for c in landed.columns if c != "body"]
    out = landed.select(*keys, F.posexplode(F.slice(rows, 1, keep)).alias("rank", "r")).filter(F.col("r").isNotNull())
    return out.select(*keys, "rank", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.url", F.lit("")).alias("url"),
                      F.coalesce("r.snippet", "r.description", F.lit("")).alias("snippet"))


def guest_prompt(name: Column, sources: Column) -> Column:
    """Prompt text from the first three sources: array<struct(title, url, snippet, quality)>."""
    def line(s: Column, i: Column) -> Column:
        tag = F.when(F.coalesce(s["quality"], F.lit("")) != "", F.concat(F.lit("["), s["quality"], F.lit("]"))).otherwise("")
        head = F.concat(F.lit("["), (i + 1).cast("string"), tag, F.lit("] "), s["title"])
        return (F.when(s["snippet"] != "", F.concat(head, F.lit("\n   摘要："), F.left(s["snippet"], F.lit(200))))
                .when(s["url"] != "", F.concat(head, F.lit(" ("), s["url"], F.lit(")"))).otherwise(head))

    context = F.array_join(F.transform(F.slice(sources, 1, 3), line), "\n")
    return F.concat(F.lit(PROMPT_HEAD), name, F.lit(PROMPT_BODY), context, F.lit(PROMPT_TAIL))


_SOURCE = "struct<title:string,url:string,snippet:string,quality:string>"


def guest_rollup(guests: DataFrame, key: str = "item_pos") -> DataFrame:
    """Item-level background of its first two guests.

    Needs guest_no, background_zh, sources (array of title, url, snippet, quality), confidence, note.
    """
    first = guests.filter(F.col("guest_no") < 2)
    ordered = F.sort_array(F.collect_list(F.struct("guest_no", _cut(F.col("background_zh"), MAX_BACKGROUND).alias("text"), "note", "sources")))

    def best(column: str, order: tuple[str, ...]) -> Column:
        out = F.lit(order[-1])
        for value in reversed(order[:-1]):
            out = F.when(F.bool_or(F.col(column) == value), value).otherwise(out)
        return out

    rows = first.groupBy(key).agg(ordered.alias("_g"), best("confidence", ("high", "medium", "low", "unknown")).alias("guest_background_confidence"))
    sources = F.slice(F.flatten(F.transform("_g", lambda g: F.coalesce(g["sources"], F.array().cast(f"array<{_SOURCE}>")))), 1, 5)
    out = rows.withColumn("guest_background_sources", sources)
    grade = F.transform("guest_background_sources", lambda s: F.coalesce(s["quality"], F.lit("secondary")))
    return out.select(
        key, F.array_join("_g.text", "；").alias("guest_background_zh"), "guest_background_sources", "guest_background_confidence",
        F.array_join("_g.note", " | ").alias("guest_background_note"),
        F.when(F.array_contains(grade, "primary"), "primary (episode_show_notes)").when(F.array_contains(grade, "secondary"), "secondary")
        .otherwise("weak").alias("source_quality_summary"))


def enrich_guests(items: DataFrame, status: DataFrame, cache: DataFrame, found: DataFrame | None = None, now: Column | None = None,
                  key: str = "item_pos") -> DataFrame:
    """Backgrounds for confirmed guests only, at most two per item: cache, else notes, else graded sources.

    `cache`: key, cached_at, detection_status, payload struct(background_zh, sources, confidence, note). `found`:
    guest_name, rank, title, url, snippet. Items without a confirmed guest keep the default text and a note why.
    """
    base = items.select(key, "podcast_name", "show_notes").join(status.drop("podcast_name"), key)
    confirmed = base.filter(F.col("guest_detection_status") == "confirmed_guest")
    guests = confirmed.select(key, "podcast_name", "show_notes", F.posexplode(F.slice("guest_names", 1, 2)).alias("guest_no", "guest_name"))
    guests = guests.withColumn("key", guest_key(F.col("guest_name"), F.lit(""), F.col("podcast_name")))
    looked = cache_ttl_lookup(guests, cache, F.current_timestamp() if now is None else now).drop("cached_at", "detection_status")
    told = guest_sentence(guest_identity(looked))
    none = F.array().cast(f"array<{_SOURCE}>")
    if found is None:
        told = told.withColumn("_found", none)
    else:
        graded = found.withColumn("quality", source_quality(F.col("title"), F.col("url"), F.col("snippet")))
        lists = top_per_key(graded, ["guest_name"], [F.col("rank")], 10).groupBy("guest_name").agg(
            F.sort_array(F.collect_list(F.struct("_rank", F.struct("title", "url", "snippet", "quality").alias("s"))))["s"].alias("_found"))
        told = told.join(lists, "guest_name", "left").withColumn("_found", F.coalesce("_found", none))

    def count(q: str) -> Column:
        return F.size(F.filter("_found", lambda s: s["quality"] == q))

    grade = quality_label(count("primary"), count("secondary"), count("weak"))
    noted = F.struct(F.lit(NOTES_TITLE).alias("title"), F.lit("").alias("url"), F.array_join("facts", " | ").alias("snippet"), F.lit("primary").alias("quality"))
    from_notes = F.col("background_zh").isNotNull()
    has_facts, has_found = F.size("facts") > 0, F.size("_found") > 0
    web = has_found & grade.isin("primary", "secondary")
    cached = F.col("cache_valid")
    # Facts that make no sentence leave it to the sources; without any facts, weak or no sources settle it.
    nothing = has_facts & ~has_found
    weak = ~has_facts & (grade == "weak")
    graded_confidence = F.when(grade == "primary", "medium").when(grade == "secondary", "low").otherwise("unknown")
    per_guest = told.select(
        key, "guest_no", "guest_name",
        F.when(cached, F.coalesce("payload.background_zh", F.lit(""))).when(from_notes, F.col("background_zh")).otherwise(NO_SOURCES).alias("background_zh"),
        F.when(cached, F.coalesce(F.col("payload.sources").cast(f"array<{_SOURCE}>"), none)).when(from_notes, F.slice(F.concat(F.array(noted), F.col("_found")), 1, 2))
        .otherwise(F.slice("_found", 1, 5)).alias("sources"),
        F.when(cached, F.coalesce("payload.confidence", F.lit("unknown"))).when(from_notes, F.col("confidence")).when(nothing, "unknown").when(weak, "low")
        .otherwise(graded_confidence).alias("confidence"),
        F.when(cached, F.coalesce("payload.note", F.lit(CACHED_NOTE))).when(from_notes, F.when(web, NOTES_AND_WEB).otherwise(NOTES_ONLY))
        .when(nothing, NO_SEARCH).when(weak, WEAK_ONLY).otherwise(DEGRADED).alias("note"))
    rolled = guest_rollup(per_guest, key)
    who = F.get("guest_names", F.lit(0))
    kind = F.col("guest_detection_status")
    reason = (
        F.when(kind == "no_guest_detected", NO_GUEST).when(kind == "mentioned_entity", F.concat(F.lit("'"), who, F.lit("'" + DISCUSSED)))
        .when(kind == "possible_guest", F.concat(F.lit("'"), who, F.lit("'" + MAYBE)))
        .when(kind == "ambiguous", F.concat(F.lit("多候选嘉宾 ['"), F.array_join("guest_names", "', '"), F.lit("']" + MANY))).otherwise(""))
    out = base.drop("show_notes").join(rolled, key, "left")
    return out.select(
        key, "podcast_name", "guest_detection_status", "guest_names", F.coalesce("guest_background_zh", F.lit(NO_NAME)).alias("guest_background_zh"),
        F.coalesce("guest_background_sources", none).alias("guest_background_sources"),
        F.coalesce("guest_background_confidence", F.lit("unknown")).alias("guest_background_confidence"),
        F.coalesce("guest_background_note", reason).alias("guest_background_note"), F.coalesce("source_quality_summary", F.lit("unknown")).alias("source_quality_summary"))
