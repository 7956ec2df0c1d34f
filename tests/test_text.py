import html
import random

from pyspark.sql import functions as F

from feedsieve.functions import text as tx

T = F.col("t")


def test_unescape_agrees_with_the_standard_library(each):
    rng = random.Random(7)
    pieces = ["&amp;", "&lt", "&#38;", "&#x26;", "&#150;", "&copy", "&notit;", "&nbsp;", "&unknown;", "&", "&#0;", "&#x1F600;", "&hellip;x", "&sup2x",
              "&ampx;", "&#xD800;", "&#11;", "&#55296;", "&CounterClockwiseContourIntegral;", " a ", ";", "文", "&#;", "&#x;", "&#1114112;"]
    cases = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(150)]
    assert each(cases, tx.unescape(T)) == [html.unescape(c) for c in cases]


def test_cleaning_keeps_line_structure(one):
    assert one("<p>AI &amp; markets</p><script>x</script>", tx.clean_html(T)) == "AI & markets"
    assert one("one.<br/>two<BR>three<br />four", tx.clean_html(T)) == "one.\ntwo\nthree\nfour"
    assert one("<ul><li>a</li><li>b</li></ul>", tx.clean_html(T)) == "a\n\nb"
    assert one("read more.https://x.test/a now", tx.clean_html(T)) == "read more. https://x.test/a now"
    assert one("see <a href='u'>this</a>page", tx.clean_html(T)) == "see this page"


def test_display_cleaning_drops_inline_tags_without_blank(one):
    assert one("<p>第一段</p><p>第二段<br>第三行</p>", tx.clean_display_html(T)) == "第一段\n第二段\n第三行"
    assert one("a<b>b</b>c　d", tx.clean_display_html(T)) == "abc d"


def test_titles(one):
    assert one('Big "John" McCarthy &amp; co\'"', tx.clean_title(T)) == 'Big "John" McCarthy & co'
    assert one('Big "John"  McCarthy\'', tx.clean_block_title(T)) == "Big John McCarthy"


def test_text_fallback_order(spark):
    def shown(*values):
        row = spark.createDataFrame([values], "a string, b string, c string, d array<string>, e string")
        return row.select(tx.best_display_text(*[F.col(x) for x in "abcde"])).first()[0]

    assert shown("first", "second", "third", ["s"], "one") == "first"
    assert shown("", None, "<p>third</p>", ["s"], "one") == "third"
    assert shown(None, None, None, ["第一句。", "", "第二句。"], "one") == "第一句。\n第二句。"
    assert shown(None, None, None, None, "one") == "one"
