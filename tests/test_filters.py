from pyspark.sql import functions as F

from feedsieve.functions import boilerplate as bp
from feedsieve.functions import language, links

T = F.col("t")


def test_blocks(one):
    text = "\n\n".join(["Intro line about things.", "Sponsors:\n- Brand one\n- Brand two", "Acme: try it now", "Body after sponsor.", "Resources:\nPaper A", "Paper B https://x.y",
                        "This episode is brought to you by Foo.", "More resources", "Credits:\nSomeone", "Produced by Jane", "Normal end."])
    got = one(text, bp.filter_blocks(T))
    assert got.text == "\n\n".join(["Intro line about things.", "Body after sponsor.", "Resources:\nPaper A", "Paper B https://x.y", "More resources", "Normal end."])
    assert got.kept_category_counts == {"body": 3, "resources": 3} and got.removed_category_counts == {"credits": 2, "sponsor": 3}
    assert got.removed_reasons == ["sponsor_section", "sponsor_marker", "credits_section"]


def test_blocks_marked_only_near_their_start(one):
    far = "word " * 30 + "thanks to our sponsors"
    assert one(far, bp.filter_blocks(T)["kept_category_counts"]) == {"body": 1}
    assert one("so many thanks to our sponsors " + "word " * 30, bp.filter_blocks(T)["removed_category_counts"]) == {"sponsor": 1}


def test_cta_section_ends_at_ordinary_text(one):
    text = "Follow us:\n@x\n\nSubscribe on the site\n\nOrdinary paragraph\n\nFollow the money is a film"
    got = one(text, bp.filter_blocks(T))
    assert got.text == "Ordinary paragraph\n\nFollow the money is a film" and got.removed_reasons == ["cta_section"]


def test_lines(one):
    text = "\n".join(["Hello", "This episode is sponsored by X", "Learn more at x.com", "Visit x", "Sign up now", "Check out y", "Real content", "Sponsors:", "- a", "", "- b", "Real two",
                      "draftkings offer", "感谢某某对本期节目的赞助播出", "visit a", "visit b", "visit c"])
    assert one(text, bp.filter_lines(T)) == "Hello\nCheck out y\nReal content\nReal two\nvisit c"
    assert one("Our sponsors:\n* one\nChapters\n* two", bp.filter_lines(T)) == "Chapters\n* two"
    assert one("use code ABC\n\nvisit now\nother", bp.filter_lines(T)) == "other"


def test_required_literals_are_in_every_match():
    assert bp.needed_literal(r"\bthanks to our sponsors?\b") == "thanks to our sponsor"
    assert bp.needed_literal(r"^stay updated:") == "stay updated:"


def test_language(each):
    english = "This episode discusses AI infrastructure, electricity markets, data centers and long term energy policy choices in detail for everyone."
    cases = {english: "en", "本期节目讨论能源市场与电力交易的长期变化，以及储能行业的发展方向。": "zh", "short": "unknown", "": "unknown", "http://a.b/" + "c" * 200: "unknown"}
    assert each(list(cases), language.detect_language(T)) == list(cases.values())
    assert each([english, english], language.needs_translation(T, F.when(F.col("i") == 0, "zh").otherwise("en"))) == [False, True]


def test_residual_ignores_original_resources(one):
    text = "本期正文已经完整翻译，讨论内容生态。\n\n延伸阅读（原文）：\n" + "The Gray Area with Sean Illing and more words to read\n" * 5
    assert one(text, language.residual_latin(T)["latin_word_count"]) == 0
    prose = "首先讨论。 " + "largely untranslated words continue here for long " * 5
    assert one(prose, language.residual_latin(T)["suspected_incomplete_translation"]) is True


def test_urls_and_copied_lines(one):
    assert one("see https://a.b/c. and www.z.com, https://a.b/c x", links.extract_urls(T)) == ["https://a.b/c", "www.z.com"]
    assert one("see https://a.b/c and www.z.com", links.append_missing_urls(T, F.lit("at https://a.b/c"))) == "at https://a.b/c\n\n原文链接：\n- www.z.com"
    source = "Keep this line same now\n00:12 Intro\n00:15 Jane Doe\nhttps://only.url/x\nother"
    assert one(source, links.untranslated_lines(T, T)) == ["Keep this line same now", "00:12 Intro"]
    assert one("Links:\nfoo\nbar", links.resource_fallback(T)) == "延伸阅读（原文）：\nfoo\nbar"
    assert one("Text\nfoo", links.resource_fallback(T)) == ""


def test_source_completeness(spark):
    df = spark.createDataFrame([("A complete sentence.", True), ("x" * 520 + ".", False), ("x" * 520, False), ("Brief", False)], "t string, cut boolean")
    got = [r[0] for r in df.select(language.source_completeness(T, T, F.col("cut"), F.lit("d"), F.lit(1))["reasons"]).collect()]
    assert got == [["upstream_truncated"], [], ["long_unterminated_source"], []]
