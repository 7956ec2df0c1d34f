"""Cases from the findings of round 4: fewer passes over the texts, with the same results."""

from dataclasses import replace
from itertools import product

import pytest
from feedsieve.functions import chunks, score, text
from feedsieve.operators import guests, quality, translate
from feedsieve.plans import adapters, weekly
from pyspark.sql import functions as F

P = adapters.TEST_POLICY
ODD = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}\r]+"


def _items(spark, texts):
    rows = [(i, i % 2, f"src{i % 2}", f"Show {i % 2}", "en" if i % 3 else "fr", 4000, 66, f"http://a.test/{i}.mp3", "2024-01-16", "2024-01-16T10:00:00Z", "2024W03", "run_1",
             t[:20] + str(i), t) for i, t in enumerate(texts)]
    names = ("item_pos bigint, feed_ord int, podcast_id string, podcast_name string, language string, duration_seconds int, duration_minutes int, audio_url string, "
             "publish_date string, pub_datetime string, week_id string, run_id string, episode_title string, show_notes string")
    return spark.createDataFrame(rows, names).withColumn("week_start", F.lit("2024-01-14").cast("timestamp"))


@pytest.mark.parametrize("mode", ["all_preview", "score_based"])
def test_a_run_builds_its_items_once(spark, tmp_path, mode):
    """Scores, guests, translations and sections read the stored items; nothing is built or dealt to the tasks again."""
    built = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            built.add(len(frame))
            yield frame

    plain = _items(spark, [f"The author Jane Miller{i} talks of the {i}. And more on the day to come for all of us here and there" for i in range(6)])
    items = plain.mapInPandas(count, plain.schema)
    hosts = spark.createDataFrame([], "podcast_name string, host string")
    done = weekly.run_week(items, replace(P, mode=mode), hosts, str(tmp_path / "w"), "2024-02-05", translate.mock_translate)
    assert done.count() == 6 and built.value == 6
    assert spark.read.parquet(str(tmp_path / "w" / "report")).where("line like '### Show%'").count() == 6


def test_reasons_need_no_texts_beside_what_was_noted(spark):
    """The quote is the first sentence with an interest word, wherever it stands; reason and warnings are those of the texts."""
    quiet, hit = "Nothing here that counts", "They talk of it all"
    cases = {f"{n}": [quiet] * n + [hit + str(n)] for n in (0, 1, 7, 8, 9, 30, 39, 40, 41, 42, 90)} | {
        f"long{n}": ["x" * n, hit, quiet] for n in (950, 980, 983, 999, 1000, 3000)} | {"none": [quiet] * 12, "short": ["x"], "empty": [""]}
    likes = replace(P, interests=replace(P.interests, boost=("of",)))
    scored = score.add_scores(_items(spark, [". ".join(c) for c in cases.values()]), likes).withColumns({
        "guest_names": F.array().cast("array<string>"), "guest_detection_status": F.lit("no_guest_detected")})
    noted = quality.with_quote(scored, likes)
    assert [r[0] for r in noted.orderBy("item_pos").select("_quote").collect()] == [
        next((s + "." * (i < len(c) - 1) for i, s in enumerate(c) if "of" in s), "") for c in cases.values()]
    narrow = noted.drop("_notes", "_low", "show_notes")

    def told(items, notes, **more):
        said = quality.reason_text(items, likes)
        return sorted(said.select("item_pos", "reason_zh", quality.quality_warnings(F.col("reason_zh"), notes, F.col("pub_datetime"), F.col("duration_minutes"), **more)).collect())

    assert told(narrow, None, size=F.col("_size")) == told(scored, F.col("show_notes"))


def test_rules_that_are_skipped_would_change_nothing(spark):
    pieces = ["a", " ", "  ", "\t", "\n", "\n\n\n", "\xa0", "　\r", "<b>", "&amp;", "é"]
    rows = spark.createDataFrame([("".join(p),) for p in product(pieces, repeat=3)], "t string")
    slow = F.col("t")
    for pattern, replacement in ((ODD, " "), (r"[ \t]{2,}", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        slow = F.regexp_replace(slow, pattern, replacement)
    bare = F.regexp_replace("t", "<[^>]+>", "")
    for entity, char in text.LIGHT_ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    differs = (text.replaced(F.col("t"), text._TIDY) != slow) | (text.strip_html(F.col("t")) != text.strip(bare))
    assert rows.where(differs).count() == 0


def test_sentence_ends_are_the_same_signs(spark):
    bits = ["a", ".", "。", "？！", "...", ">", "9", " ", "あ"]
    rows = spark.createDataFrame([("".join(p) * k,) for p in product(bits, repeat=3) for k in (1, 2, 5)], "t string")
    t, old = F.col("t"), F.split("t", "[。！？.!?]+", -1)
    sections = F.regexp_extract_all(t, F.lit(rf"(?sd).+?{chunks.STOP}+|.+\z"), F.lit(0))
    differs = (score.sentence_parts(t) != old) | (t.rlike(score.FIVE_ENDS) != (F.size(old) > 5)) | (
        sections != F.regexp_extract_all(t, F.lit(r"(?sd).+?[。！？.!?]+|.+\z"), F.lit(0)))
    assert rows.where(differs).count() == 0


def test_patterns_of_the_far_scripts_need_one_sign(spark):
    """The tests that patterns share leave what each pattern finds as it is."""
    texts = ["本期嘉宾：王小明\n嘉宾是李雷，他来了", "with Jane Miller and the author Bob Stone", "Jane在某公司做事", "🎤 Anna", "— Anna Bell", "founder Amy Lee", "a\x01b\x02 with Amy Lee", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    every, number = [], 0
    for family in guests.FAMILIES:
        for pattern, label in family.patterns:
            every.append(guests._matches(family, pattern, label, number, "description", 0))
            number += 1
    slow = F.expr(f"transform(array(translate(t, '\x01\x02', '  ')), x -> transform(array(lower(x)), low -> concat({', '.join(every)}))[0])[0]").cast(guests.CANDIDATE)
    got = rows.select(guests._text_candidates(F.col("t"), "description", 0).alias("fast"), slow.alias("slow")).collect()
    assert [r.fast for r in got] == [r.slow for r in got] and sum(len(r.fast) > 0 for r in got) >= 6
