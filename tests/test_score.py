import random

from pyspark.sql import functions as F

from feedsieve.functions import keywords as kw
from feedsieve.functions import score
from feedsieve.operators import ranking
from feedsieve.policy import Interests, Policy

T = F.col("t")


def test_keyword_edges(one):
    for text, word, hit in [("the main capital chairman is available", "ai", False), ("talk on AI now", "ai", True), ("AI行业的收钱", "ai", True),
                            ("see pplx.ai/rogan", "ai", False), ("pplx.ai and real ai here", "ai", False), ("储能市场", "储能", True), ("old data centers", "data center", False),
                            ("a c++ talk", "c++", False), ("interest rate path", "interest rate", True)]:
        assert one(text, kw.keyword_match(T, word)) is hit, (text, word)
        assert (one(text, F.size(kw.matched_words(T, (word, "zzz")))) == 1) is hit, (text, word)


def test_one_scan_agrees_with_single_matches(spark):
    rng = random.Random(3)
    vocabulary = ["ai", "data", "center", "data center", "Rate", "interest rate", "储能", "x.ai/", "model", "business model", "mo", "ai.", "a_i", "é", "ai-model"]
    words = ("ai", "data", "data center", "Rate", "interest rate", "储能", "model", "business model", "é", "mo")
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    single = F.array_sort(F.array_compact(F.array(*[F.when(kw.keyword_match(T, w), w.lower()) for w in words])))
    bad = df.filter(~single.eqNullSafe(F.array_sort(kw.matched_words(T, words)))).collect()
    assert bad == []


def test_tenths_round_like_the_binary_value(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        d = [rng.randint(0, 100) for _ in range(6)]
        rows.append((i, *d))
    names = [n for n, _ in score.WEIGHTS]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} int" for n in names))
    got = {r[0]: r[1] for r in df.select("i", score.weighted_score()).collect()}
    weights = [w / 100 for _, w in score.WEIGHTS]
    for i, *d in rows:
        total = 0.0
        for k, (v, w) in enumerate(zip(d, weights)):
            total = v * w if k == 0 else total + v * w
        assert got[i] == round(max(0, min(100, total)), 1), d


def test_density_grows_and_stays_below_the_cap(each):
    sentence = "This sentence has enough letters to count. "
    short, medium, long, empty = each([sentence, sentence * 8, sentence * 60 + "\n- item one\n- item two 10:30", " <p></p> "], score.information_density(T))
    assert 0 == empty < short < medium < long <= 100 and medium < 100


def test_full_suggestion_rules(spark):
    cases = [((60.0, 70, 0, 0, 0), "no"), ((60.0, 70, 0, 72, 0), "maybe"), ((80.0, 0, 5, 0, 0), "yes"), ((10.0, 75, 5, 0, 0), "yes"), ((10.0, 10, 5, 0, 0), "no")]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, s double, t int, topic int, strat int, act int")
    out = df.select("i", score.full_suggestion(*[F.col(c) for c in ("s", "t", "topic", "strat", "act")], Policy()))
    assert [r[1] for r in sorted(out.collect())] == [c[1] for c in cases]


def test_legacy_score_order(one):
    likes = Interests(boost=("ai", "gpu"), negative=("news",), topics=("macro",), people=("Jane",))
    assert one("ai gpu talk", score.legacy_score(T, likes)) == 6.0
    assert one("ai gpu news with jane on macro", score.legacy_score(T, likes)) == 5.0


def test_classification_order(spark):
    p = Policy(ad_words=("sponsored by",))
    cases = [(("Title", "notes", "", 3600), "missing_audio"), (("Title", "n", "http://x/paywall-intro.mp3", 3600), "paywall_preview"),
             (("T", "please subscribe to hear full-length episodes", "u", 3600), "paywall_preview"), (("Introducing: Other", "listen to episode one", "u", 3600), "cross_podcast_promo"),
             (("T", "sponsored by x", "u", 3600), "ad_only"), (("Official Trailer", "n", "u", 3600), "trailer_or_announcement"), (("T", "n", "u", 200), "below_minimum_duration"),
             ((" ", "n", "u", 3600), "invalid_metadata"), (("T", "n", "u", 600), "valid_short_episode"), (("T", "n", "u", 3600), "valid_episode")]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, t string, n string, a string, s int")
    out = df.select("i", score.classify(F.col("t"), F.col("n"), F.col("a"), F.col("s"), F.floor(F.col("s") / 60).cast("int"), p)["reason_code"])
    assert [r[1] for r in sorted(out.collect())] == [c[1] for c in cases]


def priorities(spark, scores, extra=()):
    rows = [("w", i, float(s), "preview") for i, s in enumerate(scores)] + [("w", 100 + i, float(s), "skip") for i, s in enumerate(extra)]
    df = spark.createDataFrame(rows, "week_id string, i int, final_score double, decision string")
    return {r.i: r.priority for r in ranking.relative_priority(df).collect()}


def test_relative_priority(spark):
    got = priorities(spark, [90, 80, 70, 60, 50], extra=[99])
    assert [got[i] for i in range(5)] == ["high", "medium", "medium", "low", "low"] and got[100] == "medium"
    assert priorities(spark, [90]) == {0: "medium"}
    assert list(priorities(spark, [90, 50]).values()) == ["high", "low"]


def test_priority_matches_sorting_on_many_ties(spark):
    rng = random.Random(5)
    scores = [rng.choice([10.0, 20.0, 20.0, 55.5, 70.1]) for _ in range(503)]
    ranked = sorted(scores, reverse=True)
    upper, lower = ranked[max(0, int(503 * 0.2) - 1)], ranked[max(0, int(503 * 0.6) - 1)]
    want = {i: "high" if s >= upper else "medium" if s >= lower else "low" for i, s in enumerate(scores)}
    assert priorities(spark, scores) == want


def test_weekly_limits(spark):
    rows = [("w", "full", float(90 - i), 0, i, "r") for i in range(4)] + [("w", "preview", float(50 - i), 0, 10 + i, "r") for i in range(4)] + [("w", "skip", 1.0, 0, 30, "r")]
    df = spark.createDataFrame(rows, "week_id string, decision string, final_score double, feed_ord int, item_pos int, reason string")
    got = {r.item_pos: r.decision for r in ranking.weekly_limits(df, Policy(mode="score_based", weekly_full_limit=2, weekly_preview_limit=3)).collect()}
    assert got == {0: "full", 1: "full", 2: "preview", 3: "preview", 10: "preview", 11: "preview", 12: "preview", 13: "skip", 30: "skip"}
