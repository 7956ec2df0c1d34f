import random
import re

from pyspark.sql import functions as F

from feedsieve.functions import chunks

T = F.col("t")


def greedy(units, limit, glue):
    """Plain greedy packing, the definition the regex must meet."""
    out = []
    for u in units:
        if out and len(out[-1]) + len(glue) + len(u) <= limit:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def test_paragraphs_are_packed_greedily(each):
    rng = random.Random(2)
    texts, want = [], []
    for _ in range(80):
        paras = ["w" * rng.randint(1, 60) for _ in range(rng.randint(1, 12))]
        texts.append("\n\n".join(paras))
        want.append(greedy(paras, 80, "\n\n"))
    assert each(texts, chunks.pack_chunks(T, 80)) == want


def test_long_paragraphs_are_packed_by_sentence(each):
    rng = random.Random(4)
    texts, want = [], []
    for _ in range(60):
        sentences = [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 6))) + rng.choice(".!?") for _ in range(rng.randint(2, 9))]
        text = " ".join(sentences)
        texts.append(text)
        want.append([text] if len(text) <= 60 else greedy(sentences, 60, " "))
    assert each(texts, chunks.pack_chunks(T, 60)) == want


def test_known_chunking(one):
    text = "\n\n".join(f"Paragraph {i} has some words and ends here number {i}." for i in range(6))
    got = one(text, chunks.pack_chunks(T, 120))
    assert max(map(len, got)) <= 120 and "\n\n".join(got) == text


def test_headings_open_chunks_and_lists_stay_whole(one):
    text = "Intro.\n\nLinks:\nA\n\nmore\n\nTimestamps\n" + "\n".join(f"(00:{i:02d}) point number {i}" for i in range(8))
    got = one(text, chunks.pack_chunks(T, 90))
    assert got[0] == "Intro." and got[1] == "Links:\nA\n\nmore" and got[2].startswith("Timestamps\n(00:00)")
    assert all(line in text.split("\n") for chunk in got for line in chunk.split("\n"))


def test_links_never_split(one):
    url = "https://x.test/a.?b"
    text = f"One sentence here. See {url} now. " + f"[a title. with stop](https://y.test/p.q) follows. " + "Last one is here."
    got = one(text, chunks.pack_chunks(T, 70))
    assert any(url in c for c in got) and any("[a title. with stop](https://y.test/p.q)" in c for c in got)
    assert " ".join(got) == text


def test_sections(each, one):
    text = "START " + ("中段内容。" * 120) + " END"
    got = one(text, chunks.split_sections(T, 80))
    assert "".join(got) == text and max(map(len, got)) <= 80
    assert one("a" * 200, chunks.split_sections(T, 50)) == ["a" * 200]
    assert one("no stops at all " * 20, chunks.split_sections(T, 50)) == [("no stops at all " * 20).strip()[i:i + 50] for i in range(0, 319, 50)]
    rng = random.Random(9)
    for _ in range(20):
        sentences = ["y" * rng.randint(1, 30) + rng.choice([".", "!?", "。"]) for _ in range(rng.randint(2, 8))]
        para = "".join(sentences)
        parts = re.findall(r".+?[。！？.!?]+|.+$", para)
        assert one(para, chunks.split_sections(T, 40)) == ([para] if len(para) <= 40 else greedy(parts, 40, ""))


def test_structure(each):
    cases = {"Links:\nx": "resources", "ADDITIONAL  reading": "resources", "Timestamps：": "chapters", "Corrections: one": "correction", "disclaimer text": "disclaimer",
             "Linked": "", "Resource list": "", "": ""}
    assert each(list(cases), chunks.chunk_structure(T)) == list(cases.values())


def test_an_address_of_any_length_stays_with_its_sentence(one):
    address = "https://x.test/" + "a" * 5000 + "."
    text = f"First part ends here. See {address} for more. Last part ends here. " + "More words follow. " * 50
    for limit in (400, 700, 6000):
        got = one(text, chunks.pack_chunks(F.col("t"), limit))
        assert "".join(got).replace(" ", "") == text.replace(" ", "") and "\x06" not in "".join(got)
    sentence = f"See {address} for more."
    short = sentence.replace("a" * 5000, "a" * 700)
    assert any(short in c for c in one(text.replace("a" * 5000, "a" * 700), chunks.pack_chunks(F.col("t"), 800)))
