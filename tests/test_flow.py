"""Feed body to decisions, translation, delivery states, stored runs and streams."""

import pytest
from pyspark.sql import functions as F

from feedsieve import schemas
from feedsieve.functions import when
from feedsieve.operators import delivery, documents, joins, translate
from feedsieve.plans.weekly import decide, screen
from feedsieve.policy import Interests, Policy
from feedsieve.session import new_folder
from feedsieve.sources import feeds, runs
from feedsieve.streaming import stream as st

LONG = "Jane Doe joins the show to discuss AI strategy, capital allocation, portfolio construction, and operating decisions for investors."


def item(title, date, duration, notes, url):
    return (f"<item><title>{title}</title><pubDate>{date}</pubDate><itunes:duration>{duration}</itunes:duration>"
            f"<description>{notes}</description><enclosure url=\"{url}\" type=\"audio/mpeg\"/></item>")


BODY = "<rss><channel>" + "\n".join([
    item("<![CDATA[AI Strategy &amp; Capital Allocation with Jane Doe]]>", "Wed, 27 May 2026 02:00:00 GMT", "00:42:00", f"<![CDATA[\n {LONG} ]]>", "https://e.test/1.mp3"),
    item("<![CDATA[AI Strategy &amp; Capital Allocation with Jane Doe]]>", "Wed, 27 May 2026 02:00:00 GMT", "00:42:00", "<![CDATA[Duplicate copy.]]>", "https://e.test/2.mp3"),
    item("Weekly News &amp; Sponsor Break", "Thu, 28 May 2026 03:00:00 GMT", "00:12:00", "<![CDATA[Brought to you by a sponsor.]]>", "https://e.test/3.mp3"),
    item("Outside Window", "Mon, 01 Jun 2026 03:00:00 GMT", "00:30:00", "Outside.", "https://e.test/4.mp3")]) + "</channel></rss>"
POLICY = Policy(ad_words=("sponsor", "brought to you by", "广告"), interests=Interests(boost=("AI", "capital allocation", "strategy"), negative=(), topics=("AI", "strategy"), people=("Jane Doe",)))


def test_feed_to_decisions(spark):
    bodies = spark.createDataFrame([("Mock Feed", "rss", BODY), ("Empty Feed", "rss", ""), ("Odd Feed", "other", "<rss>no items")], "podcast_name string, feed_type string, body string")
    parsed = feeds.scan_feeds_by_type(bodies)
    assert parsed.count() == 4
    start, end = (F.lit(s).cast("timestamp") for s in ("2026-05-24 14:00:00", "2026-05-31 14:00:00"))
    inside = joins.week_filter(parsed, start, end)
    assert inside.count() == 3
    ready = inside.withColumns({"podcast_id": F.lit("mock"), "feed_ord": F.lit(0), "item_pos": F.col("item_no"), "week_id": when.week_id(start)})
    rows = {r.decision: r for r in screen(ready, POLICY).collect()}
    assert set(rows) == {"preview", "skip"} and rows["skip"].decision_reason_code == "ad_only"
    assert rows["preview"].decision_reason_code == "valid_episode" and rows["preview"].item_pos == 0 and rows["preview"].novelty == 35
    assert "show_notes" not in decide(ready, POLICY).columns


def test_jsonld_pages(spark):
    page = ('<script type="application/ld+json">{"workExample":[{"name":"A","datePublished":"2026-05-27","duration":"PT10M","description":"<p>text long enough here</p>",'
            '"offers":[{"url":"http://a"}]},{"name":"B"}]}</script>')
    bodies = spark.createDataFrame([("p", "html_jsonld", page), ("q", "html_jsonld", "<script type=\"application/ld+json\">{bad</script>"), ("r", "html_jsonld", "none")],
                                   "podcast_name string, feed_type string, body string")
    got = {r.episode_title: r for r in feeds.scan_jsonld_items(bodies).collect()}
    assert set(got) == {"A", "B"} and got["A"].duration_seconds == 600 and got["A"].audio_url == "http://a" and got["B"].audio_url == ""


def test_xml_reader_keeps_text(spark, tmp_path):
    xml = '<?xml version="1.0"?><rss xmlns:itunes="i"><channel><item><title>T</title><itunes:duration>00:42:00</itunes:duration><enclosure url="http://a"/></item></channel></rss>'
    (tmp_path / "feed.xml").write_text(xml)
    row = feeds.scan_xml_items(spark, str(tmp_path)).first()
    assert row["itunes:duration"] == "00:42:00" and row.enclosure._url == "http://a"


def docs(spark, *texts):
    return spark.createDataFrame([(i, "p", f"e{i}", "", "en", t) for i, t in enumerate(texts)],
                                 "doc_id int, podcast_id string, episode_id string, episode_url string, language string, text string")


def test_translation_statuses(spark):
    def call(chunk, target):
        if "boom" in chunk:
            raise ValueError("boom")
        return "" if "empty" in chunk else chunk if "Links" in chunk or "same" in chunk else "译文"

    rows = docs(spark, "one two", "boom here", "empty here", "good words\n\nboom", "good words\n\nLinks:\nThis line stays the very same here", "", "this line is the same as before")
    out = {r.doc_id: r for r in translate.translate_chunks(rows, "doc_id", "text", call, limit=12, check_copied=True).collect()}
    assert [out[i].status for i in range(7)] == ["ok", "failed", "failed", "partial_failed", "partial_ok", "skipped", "failed"]
    assert out[4].translated_text == "译文\n\n延伸阅读（原文）：\nThis line stays the very same here" and out[4].localized_fallback_chunk_indices == [1]
    assert out[1].errors[0].error == "ValueError: boom" and out[2].errors[0].error_type == "empty_translation"


def test_second_attempt_only_for_what_failed(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(chunk, target):
        with open(log, "a") as f:
            f.write(chunk + "\n")
        tried = open(log).read().split("\n").count(chunk)
        return "" if chunk == "late" and tried < 2 else "译 " + chunk

    out = {r.doc_id: r.status for r in translate.translate_chunks(docs(spark, "late", "fine"), "doc_id", "text", call, attempts=2).collect()}
    assert out == {0: "ok", 1: "ok"} and sorted(open(log).read().split()) == ["fine", "late", "late"]


def test_cache_hits_are_not_translated_again(spark):
    text = "This episode discusses energy markets and policy in enough English words to be translated for display today."
    rows = docs(spark, text, text + " Another one.")
    empty = spark.createDataFrame([], "cache_key string, status string, translated_text string, source_hash string, model string, chunk_count bigint, translated_chunk_count bigint, "
                                  "localized_fallback_chunk_indices array<int>, errors array<struct<chunk_index:int,error_type:string,error:string,localized_fallback:boolean,unchanged_lines:array<string>>>")
    first = translate.translate_with_cache(rows, empty, "doc_id", "text")
    path = new_folder(spark, "cache")
    runs.write_cache_entries(translate.new_cache_entries(first), path)

    def never(chunk, target):
        raise AssertionError("called")

    again = translate.translate_with_cache(rows, spark.read.schema(empty.schema).parquet(path), "doc_id", "text", never).collect()
    assert {r.status for r in again} == {"cache_hit"} and all(r.translated_text.startswith("【中文翻译/mock】") for r in again)


def test_delivery_states(spark):
    cases = [((True, True, False), "skip"), ((True, True, True), "force-create"), ((False, True, False), "requires-force"), ((False, True, True), "create"), ((False, False, False), "create")]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, d boolean, m boolean, f boolean")
    assert [r[1] for r in sorted(df.select("i", delivery.delivery_action(F.col("d"), F.col("m"), F.col("f"))).collect())] == [c[1] for c in cases]


def test_rerun_replaces_only_its_own_partition(spark):
    path = new_folder(spark, "runs")
    rows = spark.createDataFrame([("2026W18", "r1", "a", "2026W18"), ("2026W19", "r2", "b", "2026W19")], "week_id string, run_id string, episode_id string, started string")
    runs.write_run_result(rows, path, "started")
    runs.write_run_result(rows.filter("run_id = 'r2'").withColumn("episode_id", F.lit("c")), path, "started")
    got = {(r.run_id, r.episode_id) for r in runs.read_runs(spark, path, "episode_id string, week_id string, run_id string").collect()}
    assert got == {("r1", "a"), ("r2", "c")}
    with pytest.raises(Exception, match="week mismatch"):
        runs.write_run_result(rows.withColumn("started", F.lit("2026W01")), path, "started")


def test_report_lines_stored_in_order(spark):
    lines = spark.range(500).select(F.lit("r").alias("run_id"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line")).repartition(7)
    path = new_folder(spark, "report")
    documents.write_lines(lines, path)
    import glob
    stored = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))).splitlines()
    assert stored == [f"line {i}" for i in range(500)]


def test_versioned_state(spark):
    root = new_folder(spark, "state")
    assert runs.read_version(spark, root, schemas.REGISTRY).count() == 0
    row = lambda e, d: (e, "p", "t", "f", "w", "l", 1, d, [d])
    runs.write_version(spark.createDataFrame([row("a", "skip")], schemas.REGISTRY), root, 1)
    merged = joins.upsert_registry(runs.read_version(spark, root, schemas.REGISTRY), spark.createDataFrame([row("a", "full"), row("b", "skip"), row("", "skip")], schemas.REGISTRY))
    runs.write_version(merged, root, 2)
    assert {r.episode_id: r.decision for r in runs.read_version(spark, root, schemas.REGISTRY).collect()} == {"a": "full", "b": "skip"}


def test_registry_batch_replay_changes_nothing(spark):
    batch = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1, "x"), ("a", "2024-01-02 00:00:00", 2, "y"), ("b", "2024-01-01 00:00:00", 3, "z")],
                                  "episode_id string, ts string, seq bigint, decision string").withColumn("ts", F.col("ts").cast("timestamp"))
    empty = spark.createDataFrame([], st.REGISTRY)
    once = st.merge_registry(empty, batch)
    assert {r.episode_id: (r.seen_count, r.decision) for r in once.collect()} == {"a": (2, "y"), "b": (1, "z")}
    older = batch.filter("seq = 1")
    assert {r.episode_id: (r.seen_count, r.decision) for r in st.merge_registry(once, older).collect()}["a"] == (3, "y")


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    streamed = st.week_counts(st.read_stream(spark, sf, events.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", [], "1 day")
    path = st.drain_to_table(streamed, "weeks")
    got = {r.week_id: r.n for r in spark.read.schema(streamed.schema).parquet(path).collect()}
    batch = {r.week_id: r.n for r in st.week_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", [], "1 day").collect()}
    assert len(got) >= 4 and all(batch[w] == n for w, n in got.items())
