"""Token files, filter audit and hard negatives."""

import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from feedsieve.llm import audit, negatives, tokens

R = random.Random(11)
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "Hello World's end\r\nand\x0bmore\x0c", "no break space\u0085here", "e ́ x́\ń", "<|endoftext|> and<|startoftext|>x", "ΣΑΣ ΟΔΟΣ\nİI", "\x1c\x1d word\x1f",
       "漢字かな交じり文が続く" * 40, "日本 語", "x" * 5000, "12345 67\t8", "don't we'LL 'S", "﻿bom", "🙂🙂 🙂‍🙂", " lead " * 3, "̈́क़ 각"]


def test_words_encoded_alone_are_the_whole_text(tokenizer):
    alphabet = ["a", "B", "H\u0331", "'", ".", "=\u0338", "e", "\u0301", "I\u0307", "<|STARTOFTEXT|>", "<|", "'s", " ", "\n", "\t", "é", "é", "́", "ß", "Σ", "ς", "1", "!", " ", " ", "漢", "🙂", "<|endoftext|>", "\x1f", "ͅ", "İ"]
    texts = ODD + ["".join(R.choices(alphabet, k=R.randint(0, 40))) for _ in range(6000)] + ['x'.join(R.choices("aB'.1 sSé\u0301-tdLV", k=R.randint(0, 25))) for _ in range(1000)] + [''.join(R.choices("aB'.1 sSé\u0301-tdLVmRE", k=R.randint(0, 25))) for _ in range(6000)]
    encode = tokens.Encoder(PATH)
    assert encode.by_piece
    ids, counts = encode(pa.array(texts, pa.string()))
    upto = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        assert ids[upto[i] : upto[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert encode(pa.array([], pa.string()))[0].size == 0
    # Slices of a few bytes, and a memory of a few parts, give the same; so do whole texts.
    before = tokens.SLICE_BYTES, tokens.KNOWN
    try:
        for tokens.SLICE_BYTES, tokens.KNOWN in ((16, 300), (1 << 23, 5)):
            again = encode(pa.array(texts, pa.string()))
            assert (again[0] == ids).all() and (again[1] == counts).all()
    finally:
        tokens.SLICE_BYTES, tokens.KNOWN = before
    encode.by_piece = False
    again = encode(pa.array(texts, pa.string()))
    assert (again[0] == ids).all() and (again[1] == counts).all()


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    ids, counts = encode(pa.array(ODD, pa.string()))
    want = [e.ids for e in plain.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert not encode.by_piece and counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_whole_documents_encode_alike(tokenizer, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids, counts = tokens.Encoder(PATH)(pa.array(texts))
    plain = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in plain] and ids.tolist() == [i for x in plain for i in x]


@pytest.mark.parametrize("kind", tokens.KINDS)
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (2, 1 << 8, 50_000, 1 << 32):
            ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            planes = tokens.split(ids, kind)
            assert len(planes) == (4 if kind == "byte" else 32) and (tokens.join(planes, n, kind) == ids).all()
    assert tokens.split(np.zeros(10, np.uint32), kind) == [b""] * (4 if kind == "byte" else 32)


@pytest.mark.parametrize("kind,block,file_ids", [("byte", 64, 500), ("bit", 100, 1 << 26), ("byte", 1 << 16, 1), ("bit", 7, 300)])
def test_files_hold_all_documents(spark, tokenizer, tmp_path, kind, block, file_ids):
    docs = [(i * 3, t, 9) for i, t in enumerate(ODD)] + [(R.randrange(400), " ".join(R.choices(["one", "two", "Three", "!!"], k=R.randint(0, 90))), 9) for _ in range(300)]
    docs += [(None, "without an id", 9), (None, None, 9), (5, "again", 9), (5, "again", 9), (-4, "before", 9)] + [(77, "hot row", 9)] * 150
    R.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, start int").repartition(5)
    folder = str(tmp_path / "ids")
    files = tokens.write(frame, folder, PATH, kind=kind, block=block, file_ids=file_ids).collect()
    got = tokens.read(spark, folder, read_ids=200).collect()
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in docs]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(d), x) for d, x in want)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and sum(f.n_ids for f in files) == at and sum(f.n_docs for f in files) == len(docs)
    # The chunk index alone leads to any range of ids.
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    for f in files:
        reader = tokens.Reader(f"{folder}/files", f.file)
        assert sum(int(c["n"]) for c in reader.chunks) == f.n_ids and len(reader.chunks) == f.n_chunks == -(-f.n_ids // block)
        for _ in range(5):
            a = R.randrange(f.n_ids)
            b = R.randint(a, f.n_ids)
            assert (reader.ids(a, b) == whole[f.start + a : f.start + b]).all()


def test_files_written_twice_are_the_same_and_damage_is_seen(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(200)], "doc_id long, text string")
    sums = []
    for name in ("a", "b"):
        tokens.write(frame.repartition(3 if name == "a" else 3), str(tmp_path / name), PATH, block=128)
        sums.append(sorted((f, zlib.crc32(open(f"{tmp_path}/{name}/files/{f}", "rb").read())) for f in os.listdir(tmp_path / name / "files") if f.endswith(".ids")))
        assert not [f for f in os.listdir(tmp_path / name / "files") if f.startswith(".part") and not f.endswith(".crc")]
    assert [f for f, _ in sums[0]] and sums[0] == sums[1]
    path = f"{tmp_path}/a/files/{sums[0][0][0]}"
    raw = bytearray(open(path, "rb").read())
    reader = tokens.Reader(f"{tmp_path}/a/files", sums[0][0][0])
    raw[int(reader.chunks[0]["offset"]) + 12] ^= 0xFF
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        tokens.Reader(f"{tmp_path}/a/files", sums[0][0][0]).chunk(0)
    open(path, "wb").write(raw[:-3])
    with pytest.raises(ValueError, match="not a whole file"):
        tokens.Reader(f"{tmp_path}/a/files", sums[0][0][0])


def test_files_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert tokens.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH).count() == 0
    assert tokens.read(spark, folder).count() == 0 and tokens.read(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids"]
    with pytest.raises(ValueError):
        tokens.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH, kind="nibble")


def test_token_query_against_plain_encoding(spark, tokenizer):
    from feedsieve.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want, at = [], 0
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op11_token_files"](spark, "/root/testdata/sf0.001").collect())) == want


def test_audit_against_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(260):
        n = R.choice([3, 199, 200, 201, 260])
        text = " ".join(R.choices(words[: R.choice([90, 101, 300])], k=n))
        text = R.choice([text, text, text + " A B C D E F G H I J K L M N O P Q R S T U V W X Y Z" * R.randint(1, 2), text + R.choice([" #", " a|b", " 5%", " @!~"]), text.upper()])
        docs.append((i, R.choice(["a", "b", None, ""]), text))
    docs += [(R.randrange(-5, 400), R.choice(["a", "c", None]), docs[R.randrange(200)][2]) for _ in range(120)]
    docs += [(None, "a", docs[0][2]), (None, None, docs[0][2]), (None, "n", None), (7, "e", None), (8, "e", ""), (8, "e", ""), (9, "é", " \t "), (1, "a", docs[3][2]), (1, "a", docs[3][2])]
    labels = [(i, R.choice([0, 1, None]), R.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, part int, failed int").repartition(3)
    got = audit.audit(frame, spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, good int"))
    assert got.columns == ["part", "filter_order", "step", *audit.NUMBERS]
    rows = got.collect()
    want = brute.audit(docs, labels)
    assert len(rows) == len(want) == 600 * len({s or "" for _, s, _ in docs})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == want
    assert audit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    none = audit.audit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(none) == (0, 0, len(want))


def test_interactions_add_up():
    n = np.random.default_rng(3).integers(0, 9, (5, 32))
    got = audit.interactions(n, n * 0, n * 0)
    last = [i for i, (_, s, _) in enumerate(audit.steps()) if s == 5]
    assert (got["kept"][:, last] == n[:, :1]).all()  # whatever the order, what passes all stays
    removed = got["removed"].reshape(5, 120, 5).sum(axis=2)
    assert (removed == (n.sum(axis=1) - n[:, 0])[:, None]).all()
    # The shares of all filters in all orders add up to 120 times what goes.
    assert (got["shapley"][:, :5].sum(axis=1) == 120 * (n.sum(axis=1) - n[:, 0])).all()


def rows_of(got):
    return collections.Counter(map(tuple, got.collect()))


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(700):
        v = centres[rng.integers(6)] + 0.4 * rng.normal(size=24)
        rows.append((i, int(rng.integers(5)), (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    rows += [(100, 1, rows[5][2]), (100, 1, rows[5][2]), (rows[9][0], rows[9][1], rows[9][2]), (None, 2, rows[7][2]), (None, 2, rows[7][2]), (701, None, rows[7][2]), (702, 1, None), (800, 1, [0.0] * 24)]
    rows += [(703, 1, [None, *rows[0][2][1:]]), (704, 1, [float("nan"), *rows[0][2][1:]]), (705, 1, [float("inf"), *rows[0][2][1:]]), (900, 3, [1.0, 2.0]), (901, 3, [1.0, 2.0]), (902, 4, [0.9, 2.0]), (1000, 3, [])]
    rows += [(-100, 2, rows[11][2]), (1100, 1, (1000 * np.array(rows[3][2])).tolist()), (1101, 1, (-5 * np.array(rows[3][2])).tolist())]
    rows += [(2000 + i, 3, rows[20][2]) for i in range(200)] + [(3000 + i, 4, rows[20][2]) for i in range(200)]  # one very common vector
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, score int").repartition(3)
    want = collections.Counter(brute.hard_negatives(rows))
    assert rows_of(negatives.hard_negatives(frame)) == want and len(want) > 150
    # Small tiles and slices, and more partitions than rows of a tile.
    before = negatives.ANCHORS, negatives.SLICE, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        negatives.ANCHORS, negatives.SLICE = 3, 7
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert rows_of(negatives.hard_negatives(frame)) == want
    finally:
        negatives.ANCHORS, negatives.SLICE = before[:2]
        spark.conf.set("spark.sql.shuffle.partitions", before[2])
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(empty).count() == 0
    assert negatives.hard_negatives(frame.where("vec_id % 100 <> 0")).count() == 0
    huge = spark.createDataFrame([(100, 1, [1e30, 1.0]), (101, 1, [1e30, 1.0]), (102, 1, [3e18, 0.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(huge).count() == 0


@pytest.mark.parametrize("size,depth", [(3, 5), (300, 64), (40_000, 700), (1 << 20, 64), ((1 << 30) - 1, 3)])
def test_residue_products_are_exact(size, depth):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (9, depth)), rng.integers(-size, size + 1, (8, depth))
    a[0], b[0] = size, -size  # the largest product, negative
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    bound = float(size) ** 2 * depth
    primes = negatives.primes_for(bound)
    got = negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes, bound < 1 << 30)
    assert got.tolist() == want


def test_relabelled(spark):
    rows = spark.createDataFrame([(7, 9), (8, 9), (0, 3), (None, 4), (14, None), (-7, 1)], "v long, label int")
    assert [r[0] for r in rows.select(negatives.relabelled(F.col("label"), F.col("v"))).collect()] == [0, 9, 4, 4, None, 2]
