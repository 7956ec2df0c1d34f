import re

import pytest
from pyspark.sql import functions as F

from feedsieve.operators import background, guests, joins
from feedsieve.operators.quality import source_quality

CASES = [
    ("投资方法论", "本期嘉宾：张三，某投资机构创始人", "", "confirmed_guest", ["张三"]),
    ("x", "今天我们的嘉宾是安克创新的创始人兼CEO阳萌。他是1982年生人，2011年开始创业。", "", "confirmed_guest", ["阳萌"]),
    ("x", "我邀请了SpaceX前火箭首席制造工程师洪力德（Lewis Hong），一起来聊聊SpaceX开发史。", "", "confirmed_guest", ["洪力德"]),
    ("x", "今天是我们的系列节目。那还是先介绍一下——Freda Duan在湾区做投资，是Altimeter Capital的合伙人。", "", "confirmed_guest", ["Freda Duan"]),
    ("x", "🎤 本期嘉宾恽雷@南方基金，基金经理", "", "confirmed_guest", ["恽雷"]),
    ("x", "节目探讨 Frida Kahlo 的艺术创作", "", "no_guest_detected", []),
    ("x", "张小珺和 Freda Duan 聊投资策略", "Host Show", "possible_guest", ["Freda Duan"]),
    ("x", "Interview with Freda Smith, founder of Example Capital.", "", "confirmed_guest", ["Freda Smith"]),
    ("#2502 - David Paulides", "David Paulides is a writer, investigator, filmmaker.", "", "confirmed_guest", ["David Paulides"]),
    ("x", "Dean Radin, PhD, is Chief Scientist at the Institute of Noetic Sciences.", "", "confirmed_guest", ["Dean Radin"]),
    ("x", "Brex co-founder and CEO Pedro Franceschi believes most people.", "", "confirmed_guest", ["Pedro Franceschi"]),
    ("x", "Jack Schwager and George Coyle team up to look at markets.", "", "ambiguous", ["Jack Schwager", "George Coyle"]),
    ("x", "David George, General Partner at Acme, and Dana Clark, CIO, discuss markets.", "", "confirmed_guest", ["David George", "Dana Clark"]),
    ("x", "Marc Andreessen joins Joe Rogan for a conversation on AI.", "", "possible_guest", ["Marc Andreessen"]),
    ('JRE MMA Show #179 with Josh Thompson & "Big" John McCarthy', "", "", "confirmed_guest", ["Josh Thompson", "Big John McCarthy"]),
    ("143. 对何小鹏的第二次访谈", "", "", "confirmed_guest", ["何小鹏"]),
    ("135. 雨森之问", "戴雨森先生来了", "", "confirmed_guest", ["戴雨森"]),
    ("x", "Trading Disclaimer: Trading in the financial markets involves a risk of loss.", "", "no_guest_detected", []),
    ("x", "Our host talks with Acme Host about things", "Acme Show", "ambiguous", ["Acme Host"]),
]


@pytest.fixture(scope="module")
def detected(spark):
    rows = [(i, t, n, p) for i, (t, n, p, _, _) in enumerate(CASES)]
    items = spark.createDataFrame(rows, "item_pos int, episode_title string, show_notes string, podcast_name string")
    hosts = spark.createDataFrame([("Host Show", "张小珺"), ("Acme Show", "Acme Host")], "podcast_name string, host string")
    aliases = spark.createDataFrame(list(guests.ALIASES), "short string, full string")
    found = guests.dedup_candidates(guests.guest_candidates(items, hosts, aliases))
    return {r.item_pos: r for r in guests.guest_status(items, found, hosts).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_detection(detected, i):
    assert (detected[i].guest_detection_status, detected[i].guest_names) == CASES[i][3:]


REASONS = {
    0: "[description/本期嘉宾] 匹配中文嘉宾短语「本期嘉宾」",
    2: "[description/chinese_name_english_alias] 中文姓名 + 英文别名格式识别为嘉宾",
    5: "[none/none] 元数据中未发现明确嘉宾标记",
    8: "[description/desc_is_a] 描述格式「Name is a...」识别为嘉宾",
    14: "[title/title_jre_mma] 标题 JRE MMA 格式识别为嘉宾 | [title/title_jre_mma] 标题 JRE MMA 格式识别为嘉宾",
    16: "[title/title_cn_num_name] 标题中文数字.名字格式识别为嘉宾（雨森为戴雨森的简称）",
}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reasons(detected, i):
    """Every evidence row says why, and the fixed sentences are those of its pattern and decision."""
    proof = detected[i].guest_detection_evidence
    assert proof and all(e.reason and "{" not in e.reason for e in proof)
    if i in REASONS:
        assert " | ".join(f"[{e.source}/{e.pattern}] {e.reason}" for e in proof) == REASONS[i]


def test_matches_and_groups_of_one_pass(spark):
    """Matches, groups and contexts equal those of a plain search; a text's own signs are blanks."""
    texts = ["Today with Ann Lee and then with Bob Stone, who is a writer.", "x" * 40 + " with Cy Dee\nwith Ed Fox Hay " + "y" * 200,
             "with Al\x01Bo Cy and\x02 with Di Ed", "with", "", "featuring Ann Lee featuring Bo Cy $1 \\ $0", "a with Gus Hay"]
    items = spark.createDataFrame([(i, "P", "t", t) for i, t in enumerate(texts)], "item_pos int, podcast_name string, episode_title string, show_notes string")
    got = sorted((r.item_pos, r.pattern, r.match_no, r.raw, r.matched_text, r.context) for r in guests.raw_candidates(items).where("family = 'en_weak'").collect())
    name, want = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}", []
    for i, t in enumerate(texts):
        t = t.replace("\x01", " ").replace("\x02", " ")
        for label, word in (("featuring_pattern", "featuring"), ("with_pattern", "with")):
            # The patterns ignore case, so any word can be part of a name.
            for n, m in enumerate(re.finditer(rf"\b{word}\s+({name})\b", t, re.I), 1):
                want.append((i, label, n, m[1], m[0][:100], t[max(0, m.start() - 20) : m.start()] + m[0] + t[m.end() : m.end() + 100]))
    assert got == sorted(want) and len(got) > 6


def test_backgrounds(spark):
    rows = [("Freda Duan", CASES[3][1]), ("David Paulides", CASES[8][1]), ("Dean Radin", CASES[9][1]), ("Jane Doe", "Jane Doe is the CEO of Hugging Face. She is a writer."),
            ("Nobody", "nothing here")]
    df = spark.createDataFrame(rows, "guest_name string, show_notes string")
    got = {r.guest_name: (r.background_zh, r.confidence) for r in background.guest_sentence(background.guest_identity(df)).collect()}
    assert got["Freda Duan"] == ("Freda Duan 是 Altimeter Capital 的合伙人。", "medium")
    assert got["Dean Radin"] == ("Dean Radin 是 Institute of Noetic Sciences 的首席科学家。", "medium")
    assert got["Jane Doe"] == ("Jane Doe 是 Hugging Face 的CEO。", "medium")
    assert got["David Paulides"][1] == "low" and got["Nobody"] == (None, None)


def test_names(each):
    cases = {"economist  Ann Lee and Bo": "Ann Lee", "\"Big\" John.,": "Big John", "Cy Dee about markets": "Cy Dee", "我的好朋友张璐": "张璐", "安克创新的创始人兼CEO阳萌": "阳萌"}
    assert each(list(cases), guests.clean_guest_name(F.col("t"))) == list(cases.values())
    noise = {"x": True, "Episode 12": True, "12 / 7": True, "12:30 talk": True, "the of": True, "Subscribe": True, "Jane Doe": False, "": True}
    assert each(list(noise), guests.name_noise(F.col("t"))) == list(noise.values())


def test_source_grades(spark):
    rows = [("a", "https://www.xiaoyuzhoufm.com/x", "..."), ("a", "https://en.wikipedia.org/wiki/X", "..."), ("a", "https://some.test/x", "short"),
            ("搜索结果", "https://some.test/x", "long enough text"), ("a", "https://some.test/x", "long enough text"), ("a", "https://duckduckgo.com/?q", "long enough text")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, u string, s string")
    assert [r[1] for r in sorted(df.select("i", source_quality(F.col("t"), F.col("u"), F.col("s"))).collect())] == ["primary", "secondary", "weak", "weak", "secondary", "weak"]


ODD = ("A\\Eb (x", "C*d [y]", "E+f? {2}", "G$h ^i", "\\Q\\E", ".* .*")


def test_names_are_never_patterns(spark):
    """Names holding quoting ends, brackets or stars are plain text everywhere."""
    rows = [(n, f"{n} is the CEO of Hugging Face. {n.split()[0]} is also a writer and actor.") for n in ODD]
    df = spark.createDataFrame(rows, "guest_name string, show_notes string")
    got = {r.guest_name: r.role_info for r in background.guest_role_list(background.guest_identity(df)).collect()}
    assert set(got) == set(ODD) and got["C*d [y]"].title == "CEO" and got["C*d [y]"].org == "Hugging Face"
    background.guest_sentence(background.guest_identity(df)).collect()
    pairs = spark.createDataFrame([(f"talk with {n} and Bob Stone, today", n) for n in ODD], "m string, n string")
    split = {r.n: r.names for r in pairs.select("n", guests.split_multi_guest(F.col("m"), F.col("n")).alias("names")).collect()}
    assert all("Bob Stone" in v for n, v in split.items() if n != ".* .*") and split["C*d [y]"][1] == "Bob Stone"
    short = spark.createDataFrame([("\\E", "x \\E王 y"), ("(", "a (b"), ("王", "今天王小明先生来了"), ("李四", "李四博士")], "name string, text string")
    names = {r.name: r.resolved_name for r in joins.expand_alias(short, spark.createDataFrame([], "short string, full string")).collect()}
    assert names == {"\\E": "\\E王", "(": "(", "王": "王小明先生", "李四": "李四博士"}


def test_background_branches(spark):
    """Cache with its sources, notes, facts without a sentence, weak and good sources."""
    items = spark.createDataFrame([(1, "P", "x"), (2, "P", "Ann Lee wrote 《Some Book》 once."), (3, "P", "nothing"), (4, "P", "Ann Lee wrote 《Some Book》 once."), (5, "P", "nothing"), (6, "P", "Jane Doe is the CEO of Hugging Face.")],
                                  "item_pos int, podcast_name string, show_notes string")
    status = spark.createDataFrame([(1, "confirmed_guest", ["Cy Dee"]), (2, "confirmed_guest", ["Ann Lee"]), (3, "confirmed_guest", ["Ed Fox"]), (4, "confirmed_guest", ["Ann Lee"]), (5, "confirmed_guest", ["Gus Hay"]), (6, "confirmed_guest", ["Jane Doe"])],
                                   "item_pos int, guest_detection_status string, guest_names array<string>")
    source = "struct<title:string,url:string,snippet:string,quality:string>"
    cache = spark.createDataFrame([("k", ("kept", [("t", "u", "s", "secondary")], "high", None))], f"k string, payload struct<background_zh:string,sources:array<{source}>,confidence:string,note:string>").select(
        background.guest_key(F.lit("Cy Dee"), F.lit(""), F.lit("P")).alias("key"), F.lit("2024-01-20").cast("timestamp").alias("cached_at"), F.lit("confirmed_guest").alias("detection_status"), "payload")
    found = spark.createDataFrame([("Gus Hay", 0, "Gus Hay - page", "https://some.test/x", "long enough text of a page")], "guest_name string, rank int, title string, url string, snippet string")
    now = F.lit("2024-02-01").cast("timestamp")
    got = {r.item_pos: r for r in background.enrich_guests(items, status, cache, found, now).collect()}
    line = lambda r: (r.guest_background_confidence, r.guest_background_note, len(r.guest_background_sources), r.source_quality_summary)
    assert got[1].guest_background_zh == "kept" and line(got[1]) == ("high", "来自缓存", 1, "secondary")
    assert line(got[2]) == line(got[4]) == ("unknown", "搜索失败，无来源", 0, "weak")
    assert line(got[3]) == ("low", "仅有弱来源（聚合页/标题片段），无法生成可靠背景", 0, "weak")
    assert line(got[5]) == ("low", "模型生成不可用，降级处理", 1, "secondary")
    assert line(got[6]) == ("medium", "来自节目元数据（show_notes）", 1, "primary (episode_show_notes)")
