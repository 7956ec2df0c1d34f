"""Cases from the findings of round 4: language, filter and sections of displayed texts."""

import re
from itertools import product

from feedsieve.functions import boilerplate, language, text
from feedsieve.operators import translate
from pyspark.sql import functions as F


def test_addresses_are_looked_for_in_their_words_only(spark):
    words = ["me@x.org", "a.b+c@d.e.f, ok", "@", "x@y", "+q@r.st-", "é@ü.ß", "HTTPS://x.y/z", "www.a", "http://", "www. x", "plain"]
    rows = spark.createDataFrame([(a + gap + b,) for a, b, gap in product(words, words, (" ", "\n", " \n ", "", "\t"))], "t string")
    t = F.col("t")
    web = language._blanked(t, language.WEB_ADDRESS, lambda p: text.holds_any(F.lower(p), ("://", "www.")))
    mail = language._blanked(t, language.MAIL_ADDRESS, lambda p: F.contains(p, F.lit("@")))
    assert rows.where((web != F.regexp_replace(t, language.WEB_ADDRESS, " ")) | (mail != F.regexp_replace(t, language.MAIL_ADDRESS, " "))).count() == 0


def test_languages_by_capped_counts_are_those_by_all_letters(spark):
    sizes = (0, 1, 9, 10, 19, 20, 39, 40, 79, 80, 81, 300)
    rows = spark.createDataFrame([(c, n, "中" * c + " 1 ".join("x" * n), d) for c, n, d in product(sizes, sizes, ("", "en", "zh", "fr"))], "c int, n int, t string, d string")
    exact, found = F.struct(F.col("c").alias("cjk"), F.col("n").alias("latin")), language.letter_counts(F.col("t"))
    differs = (language.language_of(exact) != language.language_of(found)) | (
        language.needs_translation_from(exact, F.col("d")) != language.needs_translation_from(found, F.col("d")))
    assert rows.where(differs).count() == 0
    assert rows.where("c = 0 and n = 300").select(found["latin"]).first()[0] == language.MIN_SIGNAL


def test_texts_without_hints_hold_no_marked_line(spark):
    """What patterns share is looked for first; every pattern's plain text holds one of those."""
    for patterns in (boilerplate._MARKERS, boilerplate.BOILERPLATE_LINES + boilerplate.SPONSOR_LINES + boilerplate.SPONSOR_HEADERS):
        literals = boilerplate._literals(patterns)
        shared = boilerplate._shared(literals)
        assert len(shared) < len(literals) and all(any(s in w for s in shared) for w in literals)
    cases = {"a\nSponsors:\n- x\n\nb": "a\nb", "a\nSTAY UPDATED: x\nb": "a\nb", "a \n\n\n\n b": "a\n\nb", "use code X\nvisit x\nb": "b", "a\n- x": "a\n- x"}
    got = {r.t: r.f for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", boilerplate.filter_lines(F.col("t")).alias("f")).collect()}
    assert got == cases


def test_own_sections_of_translated_texts_are_not_worked_out(spark):
    docs = spark.createDataFrame([(1, "Hello there. " * 40), (2, "use code X\nBonjour"), (3, "")], "item_pos bigint, show_notes string")
    none = F.lit(None).cast("string")
    ready = docs.select("item_pos", F.lit("en").alias("language"), F.col("show_notes").alias("show_notes_text"), "show_notes", none.alias("description"),
                        F.array().cast("array<string>").alias("summary_3_sentences_cn"), none.alias("one_line_summary_cn"), F.lit(False).alias("show_notes_truncated"),
                        F.lit("show_notes").alias("show_notes_source"), F.length("show_notes").alias("show_notes_text_len"))
    done = spark.createDataFrame([(1, "translated", "你好。" * 9), (2, "failed", "")], "item_pos bigint, status string, translated_text string")
    short = translate.display_result(ready, "item_pos", done, diagnostics=False)
    whole = translate.display_result(ready, "item_pos", done)
    assert short.columns == ["item_pos", "heading", "sections", "translation_status"] and sorted(short.collect()) == sorted(whole.select(*short.columns).collect())
    steps = re.split(r"(?=Project \[)", short._jdf.queryExecution().optimizedPlan().toString())
    assert [s.startswith("Project [item_pos") and "CASE WHEN NOT (t_clean" in s for s in steps if "draftkings" in s] == [True]
