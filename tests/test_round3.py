"""Cases from the findings of round 3."""

import os

import __spark_entry__ as entry
import compare
import public_tokenizers
from feedsieve.llm import tokens
from feedsieve.functions import score
from feedsieve.operators import dictionary, guests, joins
from feedsieve.plans import adapters, weekly
from feedsieve.sources import feeds
from pyspark.sql import functions as F

SF = os.environ.get("FEEDSIEVE_SF", "/root/testdata/sf0.001")


def test_candidate_dedup_agrees_with_sql(spark):
    ok, note = compare.compare(entry.queries()["guest_candidate_dedup"](spark, SF), compare.engine(SF), entry.oracle_sql()["guest_candidate_dedup"])
    assert ok, note


def test_phrase_is_met_by_its_runs_alone(spark):
    """Phrases of three words need no second look at texts; ends of domains, edges of texts and marks still decide."""
    words = ["red green blue", "green", "acme.com", "$x", "blue,", "a b c d e"]
    dictionary_ = spark.createDataFrame([("l", w) for w in words], "list string, keyword string")
    assert {r.word: r.whole for r in dictionary.index(dictionary_).collect()} == {
        "red green blue": True, "green": True, "acme.com": True, "$x": False, "blue,": False, "a b c d e": False}
    texts = {1: "the Red green blue sky", 2: "red green  blue", 3: "x.green/ and green", 4: "x.green and green", 5: "see a b c d e f", 6: "see a b c d ef",
             7: "so $x", 8: "so$x", 9: "$x", 10: "my blue,", 11: "my blue,x", 12: "www.acme.com/ acme.com", 13: "at acme.com", 14: "...", 15: "", 16: "bluered green blue"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.keyword) for r in dictionary.dictionary_hits(docs, dictionary_).collect()}
    want = {
        (1, "red green blue"), (1, "green"), (2, "green"), (5, "a b c d e"), (8, "$x"), (9, "$x"), (11, "blue,"), (13, "acme.com"), (16, "green")}
    assert got == want


def test_tasks_of_a_worker_share_an_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens._encoder(path, 1) is tokens._encoder(path, 1)
    assert tokens._encoder(path, 2) is not tokens._encoder(path, 1)


def test_texts_are_not_dealt_by_name(spark):
    """A frequent name would bring its texts into one task; a short list of aliases goes to the texts."""
    names = spark.range(100).selectExpr("id", "'x' || id || ' thead' AS text", "'the' AS name")
    out = joins.expand_alias(names, spark.createDataFrame([("the", "thead")], "short string, full string"))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.resolved_name for r in out.collect()} == {"thead"} and out.count() == 100


def test_records_take_the_scores_of_the_decisions(spark, monkeypatch):
    """The dimensions are worked out once, for the decisions; the reasons do not count the texts' sentences again."""
    asked, plain = [], score.information_density
    monkeypatch.setattr(score, "information_density", lambda notes: asked.append(1) or plain(notes))
    items = adapters.episodes(spark, SF).where("item_pos < 40")
    hosts = spark.createDataFrame([], "podcast_name string, host string")
    records = weekly.decision_records(items, adapters.TEST_POLICY, spark.createDataFrame([], weekly.REGISTRY), hosts, "2024-02-05")
    assert len(asked) == 1 and records.where("reason_zh <> ''").count() == records.count() > 0


def test_density_counts_sentences_up_to_its_limit(spark):
    """Real sentences count wherever they stand, also behind many short ones; more than nine earn no more."""
    long, short = "abcdefgh ijklm", "ab"
    cases = [[long] * n for n in (0, 1, 8, 9, 30)] + [[short] * 16 + [long] * n for n in (1, 12)] + [[long] * 4 + [short] * 40 + [long] * 3]
    texts = spark.createDataFrame([(i, ".".join(c)) for i, c in enumerate(cases)], "i int, t string")
    rest = score.length_score(F.length("t"))
    got = {r.i: r.credit for r in texts.select("i", (score.information_density(F.col("t")) - rest).alias("credit")).collect()}
    assert got == {i: 0 if not c else min(25, 3 * c.count(long)) for i, c in enumerate(cases)}


def test_candidate_literals_come_before_the_guards():
    """A text without a pattern's plain texts is not searched by its regular expressions."""
    labels = [label for family in guests.FAMILIES for _, label in family.patterns]
    assert set(guests.LITERALS) <= set(labels)
    sql = guests._matches(guests.FAMILIES[1], *guests.FAMILIES[1].patterns[0], 1, "description", 0)
    assert sql.startswith("if((contains(x, r'嘉宾是')")


def test_fields_an_item_lacks_are_not_searched(spark):
    cases = {"": "", "<title>x</title>": "", "<description>a</description>": "a", "<description> <![CDATA[ b ]]> </description>": "b",
             "<description><![CDATA[]]></description>": "", "<description": "", "<descriptions>c</description>": "c", "<description x='1'>d</description><description><![CDATA[e]]></description>": "d"}
    items = spark.createDataFrame([(k,) for k in cases], "item string")
    field = items.select("item", feeds._text_field(F.col("item"), "description").alias("f"))
    assert {r["item"]: r.f for r in field.collect()} == cases
    assert "CASE WHEN Contains(item" in field._jdf.queryExecution().optimizedPlan().toString()
