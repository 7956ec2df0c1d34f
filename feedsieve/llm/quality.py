"""Quality classifier from weak labels: accuracies by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedsieve.llm import kernels as K
from feedsieve.llm.common import row_key
from feedsieve.session import materialize

BUCKETS = 4096  # hashed words of the scorer
TRAINING = 6000  # documents that the scorer is fitted on, about
STEPS = 300
SMOOTHING = 20  # words added to a text's length, so that few words decide little

# Frequent function words of four languages (fixed values).
STOPWORDS = (
    "the of and to in is that for it as was with be by on not he this are or from at an a "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so "
    "le la les de des et un une du en que qui dans pour par sur au plus pas est avec ce il "
    "el los las y del se por con para su al lo como más una o").split()

_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _SYMBOL = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
_KIND[0x41:0x5B] = _UPPER
_KIND[0x61:0x7B] = _LOWER
_KIND[0x80:] = _LOWER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = _STOP
_KIND[ord("!")] = _MARK
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
NUMBERS = ("symbols", "capitals", "marks", "digits", "stopwords", "word_bytes", "repeats", "fresh")
WIDTH = 65 + len(NUMBERS) + BUCKETS + 1  # columns of the scorer: trust, byte kinds, measures, hashed words, intercept

# Labeller: measure, good up to, bad from (or good from, bad up to, where the first is larger), least number of words.
# Between the two a labeller abstains; below the least number of words it is not asked.
LABELLERS = (
    ("symbols", 0.01, 0.04, 1), ("capitals", 0.15, 0.4, 4), ("marks", 0.02, 0.2, 4), ("digits", 0.05, 0.25, 4), ("stopwords", 0.08, 0.02, 30),
    ("word_bytes", 8.5, 13.0, 10), ("repeats", 0.02, 0.1, 10), ("fresh", 0.8, 0.5, 20))


def _stop_hashes() -> np.ndarray:
    data, offsets = K.binary(pa.array(STOPWORDS))
    return np.unique(K.words(data, offsets)[0])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def measures(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray):
    """Per text: number of words and NUMBERS; per word: hash and kinds of its bytes; offsets of the texts in the words."""
    h, starts, ends, at = K.words(data, offsets, lower=True)
    n = np.diff(at).astype(np.float64)
    kind = _KIND[data]
    solid = ends - starts
    size = np.maximum(_sums(solid, at), 1)
    of_kind = {k: _sums(kind == k, offsets) for k in (_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL)}
    shape = np.bitwise_or.reduceat(kind, starts) if len(starts) else np.empty(0, np.uint8)
    shape = shape & 63
    known = stop[np.minimum(np.searchsorted(stop, h), len(stop) - 1)] == h
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    again[at[:-1][at[:-1] < len(h)]] = 0
    runs, fresh = K.rolling(h, 5), np.ones(len(n))
    for i in np.flatnonzero(n >= 5):
        mine = runs[at[i] : at[i + 1] - 4]
        fresh[i] = len(np.unique(mine)) / len(mine)
    words = np.maximum(n, 1)
    table = np.stack([
        of_kind[_SYMBOL] / size, of_kind[_UPPER] / np.maximum(of_kind[_UPPER] + of_kind[_LOWER], 1), _sums((shape & _MARK) > 0, at) / words,
        of_kind[_DIGIT] / size, _sums(known, at) / words, size / words, _sums(again, at) / words, fresh], axis=1)
    return n, table, h, shape, at


def votes(n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 abstains, 3 too few words to ask: one column per labeller."""
    out = np.full((len(n), len(LABELLERS)), 2, np.int8)
    for k, (name, good, bad, least) in enumerate(LABELLERS):
        x = table[:, NUMBERS.index(name)]
        better, worse = (x <= good, x >= bad) if good < bad else (x >= good, x <= bad)
        out[better, k], out[worse, k] = 1, 0
        out[n < least, k] = 3
    return out


def label_model(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Probability of a good document for each pattern of votes.

    Expectation-maximisation over a hidden class: each labeller votes good, bad or abstains with probabilities that
    depend on the class only; these and the share of good documents are estimated from the counts of all patterns.
    """
    names = sorted(patterns)
    if not names:
        return {}
    vote = np.array([[int(c) for c in p] for p in names])
    count = np.array([patterns[p] for p in names], float)
    # Start: share of good votes among those cast, good documents being the usual case.
    good, bad = (vote == 1).sum(1), (vote == 0).sum(1)
    p = (good + 1.0) / (good + 3.0 * bad + 2.0)
    for _ in range(rounds):
        before = p
        prior = np.clip((count * p).sum() / count.sum(), 1e-6, 1 - 1e-6)
        log_odds = np.full(len(names), np.log(prior / (1 - prior)))
        for k in range(vote.shape[1]):
            share = np.array([[(count * w * (vote[:, k] == v)).sum() + 0.5 for v in (0, 1, 2)] for w in (1 - p, p)])
            share /= share.sum(axis=1, keepdims=True)
            log_odds += np.append(np.log(share[1] / share[0]), 0.0)[vote[:, k]]
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(p - before).max() < 1e-9:
            break
    return dict(zip(names, p.tolist()))


def _profile(stop: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            for a, b in K.slices(offsets):
                n, table, _, _, _ = measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stop)
                cast = ["".join(map(str, v)) for v in votes(n, table).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("row").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(cast, pa.string())], ["doc_id", "row", "n_words", "votes"])
    return run


def _features(n, table, h, shape, at, i) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of one text: byte kinds of its words, its measures, and its hashed words, as shares.

    All are lowered for short texts, whose shares say little: with few words the intercept decides.
    """
    part = slice(at[i], at[i + 1])
    kinds = np.bincount(shape[part], minlength=64)
    found, times = np.unique(h[part] % K.U64(BUCKETS), return_counts=True)
    trust = n[i] / (n[i] + SMOOTHING)
    return (np.concatenate([np.arange(65 + len(NUMBERS)), found.astype(np.int64) + 65 + len(NUMBERS)]),
            np.concatenate([[trust], kinds / (n[i] + SMOOTHING), _scaled(table[i]) * trust, times / (n[i] + SMOOTHING)]))


def _scaled(table: np.ndarray) -> np.ndarray:
    return np.minimum(table * np.array([1, 1, 1, 1, 1, 0.05, 1, 1]), 4.0)


def _examples(stop: np.ndarray, label: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            for a, b in K.slices(offsets):
                got = measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stop)
                cast = ["".join(map(str, v)) for v in votes(got[0], got[1]).tolist()]
                rows = [_features(*got, i) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(a, b - a), pa.array([label.get(v, 0.5) for v in cast], pa.float64()),
                    pa.array([c for c, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["row", "p", "columns", "values"])
    return run


def fit(p: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic scorer (last: intercept) for soft labels p, by Adam on all examples.

    Example row[i] has value[i] in column[i]; all other columns are 0.
    """
    weight, first, second = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * weight[column], len(p)) + weight[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) / len(p)
        slope = np.bincount(column, value * off[row], WIDTH) + 1e-5 * weight
        slope[-1] = off.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weight -= 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return weight


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights from all examples of the training sample, which is bounded."""
    found = list(batches)
    lists = pa.chunked_array([b.column("columns") for b in found], pa.list_(pa.int32())).combine_chunks()
    values = pa.chunked_array([b.column("values") for b in found], pa.list_(pa.float64())).combine_chunks()
    p = np.concatenate([b.column("p").to_numpy() for b in found]) if found else np.empty(0)
    row = np.repeat(np.arange(len(p), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    weight = fit(p, row, lists.flatten().to_numpy(), values.flatten().to_numpy()) if len(p) else np.zeros(WIDTH)
    yield pa.RecordBatch.from_arrays([pa.array([weight], pa.list_(pa.float64()))], ["weight"])


def _score(stop: np.ndarray, weight: np.ndarray):
    kinds, numbers, hashed = weight[1:65], weight[65 : 65 + len(NUMBERS)], weight[65 + len(NUMBERS) : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            data, offsets = K.binary(pc.struct_field(doc, "text"))
            counts, scores = [], []
            for a, b in K.slices(offsets):
                n, table, h, shape, at = measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stop)
                z = (_sums(kinds[shape] + hashed[(h % K.U64(BUCKETS)).astype(np.int64)], at) + n * (weight[0] + _scaled(table) @ numbers)) / (n + SMOOTHING) + weight[-1]
                counts.append(n.astype(np.int64))
                scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
            if counts:
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.concatenate(counts)), pa.array(np.concatenate(scores))], ["doc", "n_words", "score"])
    return run


def classify(docs: DataFrame, threshold: float = 0.5, training: int = TRAINING) -> DataFrame:
    """Score every row of `docs` (doc_id, text and any other columns).

    Returns doc (all columns of the row), n_words, score (probability of good quality) and kept, one row per input row.

    Labellers vote good, bad or not at all on measures of the whole text. Their accuracies come from all documents: only
    the counts of the vote patterns (at most 3 to the number of labellers) reach the driver, where expectation-maximisation
    runs. The scorer is fitted on the posterior labels of about `training` documents, chosen by a hash of their content, and
    applied to all.

    Null or empty text, or no words: score 0, not kept. Null doc_id is passed on; equal rows get equal scores. Empty input:
    empty result.
    """
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    stop = _stop_hashes()
    profile = materialize(rows.mapInArrow(_profile(stop), "doc_id bigint, row bigint, n_words bigint, votes string"), "quality-votes")
    cast = profile.where("n_words > 0")
    label = label_model({r["votes"]: r["n"] for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect()})
    share = min(1.0, training / max(1, cast.count()))
    chosen = rows.where((F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.length("text") > 0))
    examples = chosen.mapInArrow(_examples(stop, label), "row bigint, p double, columns array<int>, values array<double>").dropDuplicates(["row"])
    # About `training` examples, in one task: the driver gets the weights only.
    fitted = examples.repartition(1).sortWithinPartitions("row").mapInArrow(_fitted, "weight array<double>").first()
    weight = np.array(fitted["weight"] if fitted else np.zeros(WIDTH))
    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc")).mapInArrow(_score(stop, weight), schema)
    return scored.withColumn("kept", (F.col("score") >= threshold) & (F.col("n_words") > 0))
