"""A dictionary as a table against the literal rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from feedsieve.functions.keywords import keyword_match
from feedsieve.operators import dictionary as d

TEXTS = [
    "AI strategy and the capital allocation", "available capital chairman main", "visit www.test.ai/ now for AI", "about .ai things", "AI行业的未来", "关于AI行业", "中国经济 与 科技", "科技中国经济", "a++b and c++ here", "++", "x++y ++ z",
    "xa a a", "a a a", "of the world; of  the", "OF THE", "the.x and the. y", "the.", "net.work .net/ and .net", "ünïcödé wörds ÜNÏCÖDÉ", "naïve", "", None, "éa é a", "中", "中a", "a中", "no match at all", "end with AI", "ai", "a.i. and a.i", "rock'n'roll", "rock 'n' roll/",
    "a very long beginning of a text that goes beyond thirty two characters and more", "say a very long beginning of a text that goes beyond thirty two characters", "line\nbreak here", "tab\tbreak", "under_score under", "x.co?q .co# z.co", "日本語テキスト", "of-the", "1 2 3", "12 3", " leading space", " wide"]
WORDS = ["AI", "ai", "capital", "capital allocation", "main", "AI行业", "行业", "中国经济", "中", "科技", "a中", "中a", "++", "a++b", "c++", "a a", "of the", "The", "the.", "the.x", ".net", "net", "wörds", "ÜNÏCÖDÉ", "é", "é a", "a", "e", "a.i.", "a.i", "n", "'n'", "'n' roll",
         "rock'n'roll", "a very long beginning of a text that goes beyond thirty two", "a very long beginning of a text that goes beyond thirty two characters and less", "line\nbreak", "break", "under", "under_score", "co", "日本", "本語テ", "ー", "of-the", "1 2", "12", "2 3", " leading", "leading", " ", " wide", "wide", "z", "avail", "", None, "chair"]


def expected(spark, texts, words):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = set()
    for part in range(0, len(words), 20):
        some = [w for w in words[part : part + 20] if w]
        for r in frame.select("doc_id", *[keyword_match(F.col("text"), w).alias(f"c{i}") for i, w in enumerate(some)]).collect():
            out |= {(r.doc_id, w) for i, w in enumerate(some) if r[f"c{i}"]}
    return out


def test_dictionary_agrees_with_the_literal_rule(spark):
    rng = random.Random(2)
    bits = ["a", "B", "ai", "the", "++", " ", "  ", ".", "/", "?", "中", "国", "é", "́", "_", "-", "\n", "x", "1", "#"]
    texts = TEXTS + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(250)]
    words = WORDS + list({"".join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(120)} - set(WORDS))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, word string, part string").repartition(3)
    entries = spark.createDataFrame([("all", w, 1) for w in words], "list string, keyword string, n int")
    got = [tuple(r) for r in d.dictionary_hits(docs, entries).collect()]
    assert len(got) == len(set(got))
    assert {(i, w) for i, _, w in got} == expected(spark, texts, words)


def test_dictionary_lists_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, "The AI of it"), (2, None), (3, "")], "doc_id int, text string")
    entries = spark.createDataFrame([("a", "AI"), ("a", "AI"), ("a", "ai"), ("b", "of"), ("b", "none"), ("c", None), ("c", "")], "list string, keyword string")
    got = sorted(map(tuple, d.dictionary_counts(docs, entries).collect()))
    assert got == [(1, "a", 3), (1, "b", 1)]
    assert d.dictionary_hits(docs, entries.limit(0)).count() == 0 and d.dictionary_hits(docs.limit(0), entries).count() == 0


def test_hundred_thousand_keywords(spark):
    rng = random.Random(3)
    stems = [f"w{i}" for i in range(60_000)]
    words = stems + [f"{rng.choice(stems)} {rng.choice(stems)}" for _ in range(39_000)] + [f"common {s}" for s in stems[:1000]]
    texts = [" ".join(["common"] + rng.choices(stems, k=30)) for _ in range(400)] + [f"say common {rng.choice(stems[:1000])}" for _ in range(50)] + [f"so {w} ends" for w in rng.sample(words[60_000:], 50)]
    entries = spark.createDataFrame([("l", w) for w in words], "list string, keyword string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    start = time.time()
    hits = d.dictionary_hits(docs, entries)
    got = {(r.doc_id, r.keyword) for r in hits.collect()}
    took = time.time() - start
    known, want = set(words), set()
    for i, t in enumerate(texts):
        w = t.split()
        want |= {(i, x) for x in w if x in known} | {(i, f"{a} {b}") for a, b in zip(w, w[1:]) if f"{a} {b}" in known}
        # A text begins with w1 if it begins with w12, whatever follows.
        want |= {(i, t[:n]) for n in range(2, len(t) + 1) if t[:n] in known}
    assert got == want and took < 120
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("word,core", [("of the", "﷐of﷐ ﷐the﷐"), (".net", "﷐.﷐net﷐"), ("++", "﷐++﷐")])
def test_marks(spark, word, core):
    assert d.index(spark.createDataFrame([(word,)], "keyword string")).first().inside == core
