"""Pages, lines, vectors, quality, mixing, sharding and the pipeline."""

import collections
import math
import random
from itertools import pairwise

import pytest

import brute
import corpus_pipeline
from feedsieve.llm import lines, mixing, pages, quality, sharding, vectors
from pyspark.sql import functions as F

R = random.Random(7)


def test_main_text_by_marked_article():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=a>Home</a></ul></nav>
    <div class="ad">Buy now</div><article><header><h1>Title &amp; more</h1></header><p><b>First   para<br>graph.<p>Second <i>one</i><aside>Side</aside><div id="comments"><p>Nice!</p></div><form>Mail</form></article><footer>&copy;</footer>"""
    assert pages.main_text(html) == "Title & more\nFirst para graph.\nSecond one"


def test_main_text_by_density():
    html = "<body><div id=top><a href=x>Home</a> <a href=y>About</a></div><div class=wrap><div class=story>" + "".join(f"<p>Paragraph {i} has quite some text in it, more than any link list.</p>" for i in range(4)) + \
        "</div></div><div class=x><a href=1>link one</a><a href=2>link two</a></div><div role=alert>We use cookies</div>"
    assert pages.main_text(html).split("\n") == [f"Paragraph {i} has quite some text in it, more than any link list." for i in range(4)]


def test_main_text_beyond_one_marked_article():
    long, short = ([f"{k} {i} is a paragraph with a good many words, as stories have them." * n for i in range(5)] for k, n in (("Long", 3), ("Short", 1)))
    story, other = ("".join(f"<p>{x}</p>" for x in texts) for texts in (long, short))
    # The story is in no article; a teaser is.
    assert pages.main_text(f"<body><article class=teaser><p>Read <a href=x>more of it</a></p></article><div><div>{story}</div></div></body>").split("\n") == long
    # One text in two articles, the second with shorter paragraphs.
    assert pages.main_text(f"<body><article>{story}</article><article>{other}</article><div><a href=x>A link that is none of it</a></div></body>").split("\n") == long + short
    # One paragraph, marked: what stands beside it stays out, its title does not.
    assert pages.main_text(f"<body><article><h1>Title</h1><p>{long[0]}</p></article><div><a href=1>one</a> or <a href=2>two</a></div></body>") == "Title\n" + long[0]
    assert pages.main_text(f"<body><main><h1>Title</h1><div>{story}</div></main><div><a href=1>one</a> or <a href=2>two</a></div></body>").split("\n") == ["Title", *long]


@pytest.mark.parametrize("wrapper", ('div class="layout with-sidebar"', 'div id="page" class="no-comments"', "div class=menu", "form", "fieldset", 'div role="form"'))
def test_main_text_in_a_wrapper_with_a_name(wrapper):
    story = [f"Paragraph {i} is a paragraph with a good many words, as stories have them." for i in range(4)]
    body, aside = "".join(f"<p>{p}</p>" for p in story), '<div class="sidebar"><p>A few words about us.</p></div><div id="comments">' + "<p>What a long comment this is, it takes many words to say so.</p>" * 9 + "</div>"
    name = wrapper.split()[0]
    assert pages.main_text(f"<body><{wrapper}><article>{body}</article>{aside}</{name}></body>").split("\n") == story
    assert pages.main_text(f"<body><{wrapper}><div>{body}</div>{aside}</{name}></body>").split("\n") == story
    assert pages.main_text(f"<body><p>Top</p><main><{wrapper}><article>{body}</article></{name}>{aside}</main></body>").split("\n") == story


def test_main_text_and_names_beside_it():
    story = [f"Paragraph {i} is a paragraph with a good many words, as stories have them." for i in range(4)]
    body = "".join(f"<p>{p}</p>" for p in story)
    # An article named as a comment is no mark beside a story; alone it is the text.
    for n in (1, 4, 6):
        comment = "<article class=comment><p>" + "Words that somebody wrote below the story. " * n + "</p></article>"
        assert pages.main_text(f"<body><div>{body}</div>{comment}</body>").split("\n") == story
        assert pages.main_text(f"<body>{comment}</body>").startswith("Words that")
    # A short article beside a longer advert.
    assert pages.main_text(f"<body><div class=ad>{story[0]}</div><article><h1>Title</h1><p>Short.</p></article></body>") == "Title\nShort."
    # What a name lets stay for the search is dropped again outside the core.
    assert pages.main_text(f"<body><div>{body}</div><div class=sidebar><article><p>{'A teaser without any link. ' * 5}</p></article></div></body>").split("\n") == story
    assert pages.main_text(f"<body><div class=comment><p>{story[0]}</p></div></body>") == story[0]


@pytest.mark.parametrize("html", (None, "", "   ", "<", "<p", "</p></div>", "<!-- never closed <p>x", "<script>only", "<a href='x", "plain", "<p>é&#233;&eacute;&am</p>", "<b>" * 3000 + "deep", "<div>" * 3000))
def test_main_text_survives_anything(html):
    assert isinstance(pages.main_text(html), str)


def test_extract_returns_every_row(spark):
    got = pages.extract(spark.createDataFrame([(1, "u", "<p>a b</p>", 3), (1, "u", "<p>a b</p>", 3), (None, None, None, 1)], "page_id long, url string, html string, text int"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "u", "a b", 3)] * 2 + [(None, None, "", 0)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_boilerplate_lines(spark):
    page = [(i, h, ls) for i, (h, ls) in enumerate([("a", ["top", f"own {k}", "top", "end" if k < 4 else "other"]) for k in range(40)] + [("b", ["top", "x"]), ("b", ["x"]), ("b", None), (None, ["x"]), (None, ["x"]), (None, ["x", "y"]), ("c", [])])]
    got = {r.page_id: (r.n_lines, r.n_dropped, r.text) for r in lines.drop_boilerplate(spark.createDataFrame([(*p, 1) for p in page], "page_id long, host string, lines array<string>, dropped int")).collect()}
    assert got[7] == (4, 3, "own 7")  # "end" is on a tenth of the pages, no more
    assert got[0] == (4, 2, "own 0\nend") and got[40] == (2, 0, "top\nx") and got[42] == (0, 0, "") and got[45] == (2, 1, "y") and len(got) == len(page)
    assert lines.drop_boilerplate(spark.createDataFrame([], "page_id long, host string, lines array<string>")).count() == 0


def test_lines_and_hosts(one):
    assert one("<head><title>t</title></head><p>a <b>b</b>\tc</p><!-- x --><div>d<br>e  </div>\n\n<li> </li>", lines.lines_of(F.col("t"))) == ["a b c", "d", "e"]
    assert one("HTTPS://u@Ex.ORG:8/x", lines.host_of(F.col("t"))) == "ex.org" and one("no host", lines.host_of(F.col("t"))) == "" and one(None, lines.host_of(F.col("t"))) == ""


def test_vectors_against_all_pairs(spark):
    base = [[R.gauss(0, 1) for _ in range(12)] for _ in range(60)]
    near = [[x + R.gauss(0, 0.09) for x in R.choice(base)] for _ in range(120)]
    rows = list(enumerate(base + near + [base[0]] * 30 + [[x * 5 for x in base[1]]]))
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [math.nan] * 12), (504, [math.inf] + base[0][1:]), (505, [None] + base[0][1:]), (506, base[0][:6]), (None, base[0]), (7, base[9]), (0, base[0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, weight int")
    links, low = brute.vector_links(rows)
    for group in (8192, 40):
        got = vectors.near_duplicate_vectors(df, group_rows=group).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            else:
                assert r.component_id == low[r.vec_id] and r.kept == (r.vec_id == low[r.vec_id])
                if r.vec_id not in (0, 7):  # ids of several rows
                    assert r.n_links == links[r.vec_id]
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantisation_bound_holds():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = vectors.quantise(x)
    product = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(product - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e + 1e-12).all()


@pytest.mark.parametrize("name", ("cookie-consent", "sidebar-left", "user-comment", "cookie", "gdpr-banner fixed", "related-posts", "newsletter-signup-box"))
@pytest.mark.parametrize("n", (1, 7, 24, 80))
def test_named_parts_beside_an_article_never_stay(name, n):
    story = [f"Paragraph {i} is a paragraph with a good many words, as stories have them." for i in range(5)]
    article = "<article><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in story) + "</article>"
    other = f'<div class="{name}">' + "".join(f"<p>Line {i} of what is not the article, long enough to look like one.</p>" for i in range(n)) + "</div>"
    for page in (f"<body>{other}{article}</body>", f"<body><div>{article}{other}</div></body>", f"<body><main>{article}{other}</main></body>", f"<body><form>{article}</form>{other}</body>"):
        assert pages.main_text(page).split("\n") == ["Title", *story]
    # Inside the article too, but for most of it.
    if n < 5:
        assert pages.main_text(f"<body>{article.replace('</article>', other + '</article>')}</body>").split("\n") == ["Title", *story]


def test_names_and_elements_inside_an_article():
    story = [f"Paragraph {i} is a paragraph with a good many words, as stories have them." for i in range(5)]
    body = "".join(f"<p>{p}</p>" for p in story)
    for name in ("related-work", "notice-period", "share-price", "search-engine", "comment-on-law", "ad-hoc"):
        for tag in ("div", "p", "section"):
            got = pages.main_text(f'<body><nav><a href=x>Home</a></nav><article>{body}<{tag} class="{name}">What it says of its subject.</{tag}></article></body>')
            assert got.split("\n") == [*story, "What it says of its subject."], name
    inside = {"Water is H<math><msub><mi></mi><mn>2</mn></msub></math>O, press <button>Go</button> for more.": "Water is H2O, press Go for more.",
              "An <svg><title>x</title><path d=1/><text>no</text></svg>icon, <audio src=a>none</audio>a tune, <select><option>1<option>2</select> the end.": "An icon, a tune, the end.",
              "One <script>var a;</script>sentence <noscript>no</noscript>stays <video><source src=b>none</video>whole.": "One sentence stays whole."}
    for html, text in inside.items():
        assert pages.main_text(f"<body><article>{body}<p>{html}</p></article></body>").split("\n") == [*story, text]
    got = pages.main_text(f"<body><article>{body}<button>Share this</button><form>Mail <button>Send</button></form></article></body>")
    assert got.split("\n") == story
    # What holds most of the article is the article, whatever its name.
    assert pages.main_text(f'<body><article><h1>T</h1><div class="newsletter-body">{body}</div></article></body>').split("\n") == ["T", *story]


def test_label_model_finds_accuracies():
    r = random.Random(3)
    counts = collections.Counter()
    for _ in range(20000):
        good = r.random() < 0.8
        counts["".join(str(int(good == (r.random() < a))) if r.random() < 0.9 else "2" for a in (0.95, 0.9, 0.85, 0.6))] += 1
    p = quality.label_model(counts)
    assert p["1111"] > 0.95 and p["0000"] < 0.05 and p["1100"] > p["0011"] and quality.label_model({}) == {}


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: bool(r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).select("doc.doc_id", "kept").collect()
    right = [r.kept == label[r.doc_id] for r in got if r.doc_id in label]
    assert sum(right) / len(right) >= 0.98


def test_classifier_edges(spark):
    texts = [(1, "The cat and the dog went to the park and it was good for all of them.", 1, "a"), (2, None, 1, "b"), (3, "", 1, "c"), (None, "### $$$ %%%", 1, "d"), (4, "x " * 5000, 1, "e"), (4, "x " * 5000, 1, "e")]
    got = quality.classify(spark.createDataFrame(texts, "doc_id long, text string, score int, doc string"))
    assert sorted((r.doc.doc_id or -1, r.n_words) for r in got.collect()) == [(-1, 3), (1, 17), (2, 0), (3, 0), (4, 5000), (4, 5000)]
    assert not any(r.kept for r in got.collect() if r.n_words == 0) and got.select("doc.*").columns == ["doc_id", "text", "score", "doc"]
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mix_meets_targets(spark):
    docs = [(i, R.choice("aab"), R.randint(0, 30)) for i in range(3000)] + [(i, "c", 10) for i in range(3000, 3050)] + [(9, None, 40), (None, "d", 7), (None, "d", 7), (1, "a", docs_size := 5), (1, "a", docs_size)]
    got = mixing.mix(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, size long, copies int")).collect()
    assert len(got) == len(docs) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    sums, target, size = collections.Counter(), {}, {}
    for r in got:
        sums[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert sum(sums.values()) <= sum(s for _, _, s in docs) and all(abs(sums[s] - target[s]) <= 90 for s in target)
    assert size == dict(collections.Counter({s: sum(x[2] for x in docs if x[1] == s) for s in target})) and all(target[s] <= 3 * size[s] + 1e-6 for s in target)
    # a, b, c, d, null weigh 5, 2, 1, 5, 2; no open source lies below another's share of its weight.
    weight = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    level = max(target[s] / weight[s] for s in target)
    assert all(math.isclose(target[s], min(3 * size[s], level * weight[s])) for s in target) and math.isclose(sum(target.values()), sum(size.values()))
    again = mixing.mix(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, size long, copies int").repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_shards_are_even_and_move_little(spark):
    docs = [(i, i % 50 + 16, i * 7) for i in range(4000)] + [(None, 16, 0)] * 300 + [(5, 21, 35)] * 4
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, size long, text_crc32 long, shard int")
    first, more = (sharding.every_slot(sharding.shard(df, shards=n)).collect() for n in (40, 41))
    for got, n in ((first, 40), (more, 41)):
        places = collections.defaultdict(list)
        for r in got:
            places[r.shard].append(r.slot)
        sizes = sorted(len(p) for p in places.values())
        assert len(places) == n and sizes[-1] - sizes[0] <= 1 and all(sorted(p) == list(range(len(p))) for p in places.values())
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(docs)
    place = {r.doc_id: r.shard for r in first if r.doc_id is not None and r.doc_id > 5}
    moved = sum(place[r.doc_id] != r.shard for r in more if r.doc_id in place)
    assert moved < 0.12 * len(place)  # plain modulo moves 97 %
    assert sharding.shard(spark.createDataFrame([], "doc_id long, size long, text_crc32 long")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_shards_equal_a_plain_ring(seed):
    """Ranges of rows go where rows go that walk the ring one by one."""
    r = random.Random(seed)
    shards, replicas, positions = r.choice((1, 3, 7)), r.choice((1, 4)), 64
    counts = {p: r.choice((1, 2, 9)) for p in r.sample(range(positions), r.randrange(40))}
    if seed % 3 == 0:
        counts[r.randrange(positions)] = 300  # a third of all rows or more
    got = {}
    for position, low, high, shard, first in sharding.placements(counts, shards, replicas, positions):
        for rank in range(low, high):
            assert (position, rank) not in got
            got[position, rank] = shard, first + rank - low
    want, _ = brute.walk_ring(counts, sharding.ring(shards, replicas, positions), shards)
    assert {k: s for k, (s, _) in got.items()} == want
    for s in range(shards):
        slots = sorted(slot for shard, slot in got.values() if shard == s)
        assert slots == list(range(len(slots)))


def test_sizes_and_words_of_odd_texts(spark):
    import zlib

    texts = [None, "", " ", "é", "日本\u00a0語", "a\tb\x0bc\x0cd\r\ne  f", "\u2003x\u0085y z", "x" * 100_000, "\U0001f600 " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", *sharding.size_and_digest(F.col("text")), mixing.words_in(F.col("text")).alias("words")).collect()
    plain = [(t or "").encode() for t in texts]
    assert {r.i: (r.size, r.text_crc32, r.words) for r in got} == {i: (len(b) + 16, zlib.crc32(b), len(b.split())) for i, b in enumerate(plain)}


def test_ring_nodes_stay():
    assert set(sharding.ring(40)) <= set(sharding.ring(41)) and all(a <= b for a, b in pairwise(sharding.ring(40)))


def test_pipeline_stages(spark, tmp_path):
    texts = [f"The {a} and the {b} of it went to the {c} because it was {d} for all of them in the end, as {a} said to {d}." for a in ("cat", "dog", "cow") for b in ("house", "tree") for c in ("park", "lake") for d in ("good", "bad")]
    docs = [(i, t, "en", f"s{i % 3}", len(t), "k") for i, t in enumerate(texts)]
    docs += [(100, docs[0][1], "en", "s1", 3, "k"), (101, "### $$$ %%% ###!! $$$!! " * 20, "en", "s1", 3, "k"), (102, None, None, None, None, None), (103, "", "en", "s1", 0, "k"), (None, docs[1][1], "en", "s2", 5, "k"), docs[5], docs[5]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    spark.createDataFrame([(1, " ".join(texts[2].split()[3:15]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns, name
        rows = [tuple(r) for r in kept.collect()]
        assert set(rows) <= set(docs), name
        if name.startswith("quality"):
            assert not {101, 102, 103} & {r[0] for r in rows} and {r[0] for r in rows} >= set(range(len(texts)))
            before = rows
        elif name.startswith("n-gram"):
            low = brute.jaccard([(r[0], r[1]) for r in before])
            assert collections.Counter(rows) == collections.Counter({r: 1 for r in before if r[0] is None or low[r[0]] == r[0]})
            before = rows
        elif name.startswith("benchmark"):
            leaks = {d for d, _ in brute.contaminated([(k, r[1]) for k, r in enumerate(before)], [(1, " ".join(texts[2].split()[3:15]))])}
            assert sorted(rows, key=repr) == sorted((r for k, r in enumerate(before) if k not in leaks), key=repr) and leaks
        else:
            assert max(collections.Counter(rows).values()) <= 3
    final = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path))
    assert final.columns == [*frame.columns, "_shard", "slot"]
    assert collections.Counter(tuple(r)[:6] for r in final.collect()) == collections.Counter(tuple(r) for r in kept.collect())


def test_near_duplicates_by_row(spark, tmp_path):
    r = random.Random(9)
    a, b, c, d = (" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(4))
    # Two texts have id 7: one is a near copy of 3's, the other of nothing; two near copies have id 5, one id is smaller by one.
    rows = [(3, a, 1), (7, a + " end", 1), (7, b, 1), (5, c, 1), (5, c + " end", 1), (4, c + " and more", 1), (-6, d, 1), (8, d, 2), (6, "", 1), (None, b, 1), (7, b, 1)]
    got = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, row int"), str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[i] for i in (0, 2, 5, 6, 8, 9)], key=repr) and got.columns == ["doc_id", "text", "row"]
    # Near copies of one id: one stays.
    got = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(rows[3:5], "doc_id long, text string, row int"), str(tmp_path))
    assert got.count() == 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
