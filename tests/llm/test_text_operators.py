"""Word, byte and shingle operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from feedsieve.llm import benchmark, bwt, jaccard, substrings, suffixes
from feedsieve.llm import kernels as K

RANDOM = random.Random(11)
VOCABULARY = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(900)]


def prose(n, r=RANDOM):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, changes, r=RANDOM):
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


PASSAGE = prose(70)
BASE = [prose(n) for n in (120, 300, 90, 60)]
TEXTS = (
    [BASE[0]] * 4 + [edited(BASE[0], k) for k in (1, 2, 3, 5, 8, 20)] + [edited(BASE[1], k) for k in (1, 10, 15, 16, 17, 30)] + [BASE[1].upper().replace("É", "é")]
    + [prose(40) + " " + PASSAGE + "\n" + prose(30) for _ in range(12)] + [PASSAGE, PASSAGE + " " + PASSAGE]
    + [None, "", " \t\n", "one", "One", "two words", "a b c d", "A b\tc d", "same " * 300, "same " * 300 + "end", "é" * 500, "x" * 400 + "y" * 400, prose(4000), "\x1c\x85 odd spaces here " * 30]
    + [BASE[2], BASE[2] + " tail", "head " + BASE[2], BASE[3] + " " + BASE[3]])
DOCS = [(i * 3 % 101, t) for i, t in enumerate(TEXTS)] + [(None, BASE[0]), (None, None), (0, TEXTS[0]), (3, prose(80)), (3, BASE[3])]


@pytest.fixture(scope="module")
def docs(spark):
    clash = [(i, t, 1, "x", i, 2) for i, t in DOCS]
    return spark.createDataFrame(clash, "doc_id long, text string, row int, cell string, n_words long, signature int").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, *names):
    return sorted(((tuple(r[n] for n in names)) for r in df.collect()), key=repr)


def test_word_windows(docs, none):
    got = rows(substrings.remove_repeated_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows_removed(DOCS), key=repr)
    assert any(r[2] for r in got) and rows(substrings.remove_repeated_windows(none), "doc_id") == []


@pytest.mark.parametrize("width", (1, 3, 200))
def test_word_windows_with_a_small_sketch(docs, width):
    """Counters that nearly all anchors share only let more windows through to the exact pass."""
    got = rows(substrings.remove_repeated_windows(docs, width=width), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows_removed(DOCS), key=repr)


def test_sketch_never_underestimates(spark):
    r = random.Random(5)
    held = [(i, sorted({r.randrange(400) for _ in range(30)})) for i in range(40)]
    cells = spark.createDataFrame(held, "row long, cells array<long>")
    counts = collections.Counter(c for _, cs in held for c in cs)
    runs = cells.select(F.explode("cells").alias("cell")).distinct()
    repeated = {c for c, n in counts.items() if n > 1}
    for width in (1, 50, 100_000):
        kept = {x.cell for x in substrings.estimated_repeated(runs, substrings.sketch(cells, width), width).collect()}
        assert repeated <= kept <= set(counts)
    assert kept == repeated and len(repeated) < len(counts)


@pytest.mark.parametrize(("many", "piece"), ((4096, 1 << 22), (1, 1 << 22), (4096, 150)))
def test_byte_windows(docs, monkeypatch, many, piece):
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    got = rows(suffixes.remove_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.bytes_removed(DOCS), key=repr)


def test_byte_windows_of_nothing(none):
    assert rows(suffixes.remove_repeated_bytes(none), "doc_id") == []


def test_merged_transforms_equal_counting():
    import numpy as np

    for seed in range(25):
        r = random.Random(seed)
        letters, base = r.choice([b"ab", b"a", bytes(range(256)), b"abcdef\0"]), bytes(r.choice(b"abc") for _ in range(60))
        counts = [r.randint(1, 20) for _ in range(r.randint(1, 25))]
        segments = [bytes(r.choice(letters) for _ in range(n + 15)) if r.random() < 0.4 else (base * 3)[(o := r.randrange(60)) : o + n + 15] for n in counts]
        weights = [r.choice((1, 1, 2)) for _ in counts]
        seen = collections.Counter()
        for s, n, w in zip(segments, counts, weights):
            for i in range(n):
                seen[s[i : i + 16]] += w
        want = [[i for i in range(n) if seen[s[i : i + 16]] > 1] for s, n in zip(segments, counts)]
        assert [x.tolist() for x in bwt.repeated(segments, np.array(counts), np.array(weights), 16, r.choice((1, 3, 4)))] == want


def test_jaccard_components(docs, none):
    got = rows(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    low = brute.jaccard(DOCS)
    assert got == sorted(((i, len(set(brute.shingles(t))), low.get(i)) for i, t in DOCS), key=repr)
    assert rows(jaccard.near_duplicates(none), "doc_id") == []


def test_words_of_long_texts_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["a bb\tccc " * 40 + "end", "", "x" * 90, " lead", None, "tail \n", "y" * 30 + " " + "z" * 50]
    data, offsets = K.binary(pa.array(texts))
    whole = K.words(data, offsets, True)
    for piece in (1, 7, 40, 64):
        monkeypatch.setattr(K, "PIECE_BYTES", piece)
        for a, b in zip(whole, K.words(data, offsets, True)):
            assert np.array_equal(a, b)


def test_sketch_distance_is_a_lower_bound():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m in ((10, 12), (100, 90), (700, 650), (5000, 5200)):
        pool = r.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + m])
        x, y = jaccard.sketch(a)[None], jaccard.sketch(b)[None]
        while x.shape != y.shape:
            x, y = (jaccard.fold(x), y) if x.shape[1] > y.shape[1] else (x, jaccard.fold(y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_similar_sets_share_a_block():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (3, 4, 7, 30, 63, 64, 70, 85, 86, 200, 511, 512, 600, 690, 4000, 5000):
        for _ in range(8):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(r.integers(0, n // 4 + 1))
            more = int(r.integers(0, n // 3 + 1))
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, more, dtype=np.uint64)]))
            if 100 * (n - gone) >= 75 * (n + more):
                heavy = np.sort(r.choice(a, n // 2, replace=False))
                assert set(jaccard.signatures(a, heavy)[0].tolist()) & set(jaccard.signatures(b, heavy)[0].tolist()), (n, gone, more)


def test_decontamination(spark, docs):
    r = random.Random(2)
    items = [(i, prose(r.randint(2, 60), r)) for i in range(25)] + [(90, None), (91, ""), (92, "a b c d"), (93, "A B C D"), (94, PASSAGE), (None, prose(20, r))]
    texts = list(DOCS)
    for n in range(120):
        w = r.choice(items[:25])[1].split()
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(w))
            w[p : p + r.randint(0, 1)] = [] if r.random() < 0.3 and len(w) > 1 else ["edit"]
        texts.append((200 + n, prose(r.randint(0, 60), r) + " " + " ".join(w) + " " + prose(r.randint(0, 60), r)))
    found = benchmark.contaminated(spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.contaminated(texts, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 40


def test_decontamination_of_parts_in_another_order(spark):
    r = random.Random(4)
    a, b, c = (prose(50, r) for _ in range(3))
    items = [(1, f"{a} {b}"), (2, f"{a} {b} {c}"), (3, f"{a} {a}")]
    texts = [(i, " ".join(x for x in (prose(before, r), t, prose(after, r)) if x)) for i, (t, before, after) in enumerate(
        (t, before, after) for t in (f"{b} {a}", f"{b} {c} {a}", f"{c} {a} {b}", f"{a} {b}", a) for before, after in ((0, 0), (30, 0), (0, 30), (45, 60)))]
    texts.append((99, f"{b} {prose(8, r)} {a}"))
    found = benchmark.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.contaminated(texts, items)
    assert {(x["doc_id"], x["item_id"]) for x in found} == want.keys() and len(want) >= 16
    assert all(abs(x["similarity"] - want[x["doc_id"], x["item_id"]]) < 1e-9 for x in found)


def test_decontamination_agrees_with_sql(spark, tmp_path):
    """Passages in another order, edited ones, ties, repeated shingles, short items and documents."""
    import compare
    from feedsieve.llm.queries import ORACLES, QUERIES

    r = random.Random(9)
    a, b, c = (prose(24, r) for _ in range(3))
    items = [(1, f"{a} {b}"), (2, f"{a} {b} {c}"), (3, f"{a} {a}"), (4, "a b c"), (5, "same " * 40), (6, None), (7, " ")]
    texts = [" ".join(x for x in (prose(before, r), t, prose(after, r)) if x) for t in (f"{b} {a}", f"{b} {c} {a}", f"{c} {a} {b}", f"{a} {b}", f"{a} {a} {a}", edited(f"{a} {b}", 1, r))
             for before, after in ((0, 0), (20, 0), (0, 20), (30, 45))] + [a, None, "", "A b\tC", "x a b c a b c", "same " * 200, f"{b} {prose(4, r)} {a}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = compare.duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ok, note = compare.compare(QUERIES["op6_decontaminate"](spark, str(tmp_path)), con, ORACLES["op6_decontaminate"])
    assert ok, note


def test_decontamination_of_many_equal_words(spark):
    """Every one of 10^5 windows is a candidate; no row holds the document's hashes once for each."""
    docs = spark.createDataFrame([(1, "same " * 100_000), (2, "other " * 100_000)], "doc_id long, text string")
    found = benchmark.contaminated(docs, spark.createDataFrame([(7, "same " * 50)], "item_id long, text string")).collect()
    assert [(x["doc_id"], x["item_id"], x["similarity"], x["start"]) for x in found] == [(1, 7, 1.0, 0)]


def test_starts_are_all_that_cover_enough(spark):
    r = random.Random(6)
    cases = [(total, n, need, sorted(r.sample(range(total), r.randint(0, total)))) for total in (1, 4, 9, 25) for n in (1, 3, 8, 30) for need in (1, 2, 5, 8) for _ in range(4)]
    cases = [(total, n, min(n, total), need, places) for total, n, need, places in cases]
    got = spark.createDataFrame(cases, "total int, long int, wide int, need int, places array<int>").selectExpr("*", f"{benchmark._STARTS} AS starts").collect()
    for x in got:
        assert x["starts"] == [s for s in range(max(0, x["total"] - x["long"]) + 1) if sum(s <= p < s + x["wide"] for p in x["places"]) >= x["need"]], x


def test_decontamination_of_nothing(spark, docs, none):
    assert benchmark.contaminated(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert benchmark.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_of_equal_digit_sums_differ(spark):
    """Words whose hashes by powers of any odd base agree modulo 2**64."""
    import numpy as np

    for n in (1024, 2048, 4096):
        one, two = thue_morse(n), thue_morse(n, "b", "a")
        data, offsets = K.binary(pa.array([one, two, one]))
        h = K.words(data, offsets)[0]
        assert h[0] != h[1] and h[0] == h[2]
        docs = spark.createDataFrame([(1, one), (2, two), (3, "same " * 49 + one), (4, "same " * 49 + two)], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
        if n == 1024:
            assert {r.doc_id: r.n_removed for r in substrings.remove_repeated_windows(docs).collect()} == dict.fromkeys(range(1, 5), 0)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 12))) for _ in range(3000)] + ["x" * k for k in range(1, 400)]
    data, offsets = K.binary(pa.array([" ".join(words)]))
    assert len(set(K.words(data, offsets)[0].tolist())) == len(set(words))
