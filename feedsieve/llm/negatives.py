"""Hard negatives by exact integer scores: products of residues modulo small primes, then windows of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.session import materialize

SCALE = 256
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100  # per cent of a positive's score between which a negative's lies
ANCHORS = 2048  # anchors of a tile, about
SLICE = 512  # rows multiplied at once

PRIMES = (509, 503, 499, 491, 487, 479, 467, 463)
DEPTH = 256  # 256 * 254 * 254 < 2 ** 24: so many terms add up without rounding in single precision
LONGEST = float(2**62)  # squared length of a vector from which its scores may not fit 64 bits

_FOUND = "anchor bigint, anchor_id bigint, label int, copies bigint, k int, hash bigint, vec_id bigint, weight bigint, score bigint"
_KEY = ("anchor", "anchor_id", "label")


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Signed residues of whole numbers, in single precision."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def _reduce(c: np.ndarray, p: int) -> np.ndarray:
    """c modulo p, close to zero; exact while |c| < 2 ** 24."""
    return c - np.rint(c * np.float32(1 / p)) * np.float32(p)


def primes_for(bound: float) -> tuple[int, ...]:
    """So many primes that all whole numbers up to `bound`, of either sign, have residues of their own."""
    product, used = 1, []
    for p in PRIMES:
        if 0.49 * product > bound + 1:
            break
        used.append(p)
        product *= p
    return tuple(used)


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...], small: bool) -> np.ndarray:
    """Exact inner products of all rows of a and b, given by their residues.

    One matrix product per prime, then Garner's form of the Chinese remainder theorem: digit i of the result in the mixed base
    of the primes, close to zero, so signs come out by themselves.
    """
    kind = np.int32 if small else np.int64
    digits, base, out = [], 1, None
    for i, p in enumerate(primes):
        c = np.zeros((len(a[i]), len(b[i])), np.float32)
        for k in range(0, a[i].shape[1], DEPTH):
            c += _reduce(a[i][:, k : k + DEPTH] @ b[i][:, k : k + DEPTH].T, p)
        power = 1
        for q, digit in zip(primes, digits):
            c -= digit * np.float32((power + p // 2) % p - p // 2)
            power *= q
        c = _reduce(c, p)
        inverse = pow(base, -1, p)
        c = _reduce(c * np.float32((inverse + p // 2) % p - p // 2), p)
        digits.append(c)
        term = c.astype(kind) * kind(base)
        out = term if out is None else out + term
        base *= p
    return out


class _Tile:
    """Anchors of one tile, and the best rows found for each of their aims while the tile's rows pass by in tie order."""

    def __init__(self, anchors: pa.Table, aimed: bool):
        self.hash, self.copies = (anchors[k].to_numpy() for k in ("hash", "weight"))
        self.id, self.label = anchors["vec_id"], anchors["label"].to_numpy()
        self.same = not aimed
        self.whole = _matrix(anchors)
        self.length = float(np.sqrt((self.whole.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
        self.by_primes: dict[tuple[int, ...], list[np.ndarray]] = {}
        n = len(self.hash)
        if aimed:
            aims = anchors["aims"].to_pylist()
            best = np.full((n, POSITIVES), -1, np.int64)
            for i, scores in enumerate(aims):
                best[i, : len(scores)] = scores
            # A positive below zero has an empty range, as 80 % of its score lies above it.
            self.high = np.where(best >= 0, best * HIGH // 100, -1)
            self.low = np.where(best >= 0, -(-best * LOW // 100), np.iinfo(np.int64).max)
        else:
            self.high, self.low = np.full((n, 1), np.iinfo(np.int64).max), np.full((n, 1), np.iinfo(np.int64).min)
        self.width = self.high.shape[1]
        self.keep = NEGATIVES if aimed else POSITIVES
        self.pool = {k: np.empty(0, np.int64) for k in ("pair", "score", "hash", "id", "weight")} | {"none": np.empty(0, bool)}

    def add(self, rows: pa.Table) -> None:
        for a in range(0, rows.num_rows, SLICE):
            self._slice(rows.slice(a, SLICE))

    def _slice(self, rows: pa.Table) -> None:
        x = _matrix(rows)
        hashes, weight, label = (rows[k].to_numpy() for k in ("hash", "weight", "label"))
        ids, none = rows["vec_id"].fill_null(0).to_numpy(), rows["vec_id"].is_null().to_numpy()
        bound = self.length * float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) * (1 + 1e-9)
        primes = primes_for(bound)
        if primes not in self.by_primes:
            self.by_primes[primes] = residues(self.whole, primes)
        small = bound < 1 << 30
        score = products(self.by_primes[primes], residues(x, primes), primes, small)
        fits = (self.label[:, None] == label) == self.same
        lowest = np.iinfo(score.dtype).min
        score[~fits] = lowest  # no score is as low
        own = self.hash[:, None] == hashes if self.same else None
        least = np.maximum(self.low, self._worst())
        for k in range(self.width):
            low = np.clip(least[:, k], lowest + 1, np.iinfo(score.dtype).max)
            inside = (score >= low[:, None].astype(score.dtype)) & (score <= np.clip(self.high[:, k], lowest, np.iinfo(score.dtype).max)[:, None].astype(score.dtype))
            inside &= (least[:, k] <= np.iinfo(score.dtype).max)[:, None]
            i, j = np.nonzero(inside)
            if not len(i):
                continue
            w = weight[j]
            if own is not None:  # an anchor's other copies are rows of their own, itself is not
                me = own[i, j] & (ids[j] == self.ids()[i]) & (label[j] == self.label[i])
                w = w - me
                i, j, w = i[w > 0], j[w > 0], w[w > 0]
            self._merge(i * self.width + k, score[i, j].astype(np.int64), hashes[j], ids[j], none[j], w)

    def ids(self) -> np.ndarray:
        return self.id.fill_null(0).to_numpy()

    def _worst(self) -> np.ndarray:
        """Score that a later row must reach: rows come in tie order, so it must exceed that of the last of a full list."""
        out = np.full(len(self.hash) * self.width, np.iinfo(np.int64).min)
        pair = self.pool["pair"]
        full = np.flatnonzero(np.bincount(pair, minlength=len(out)) >= self.keep)
        out[full] = self.pool["score"][np.searchsorted(pair, full, "right") - 1] + 1
        return out.reshape(-1, self.width)

    def _merge(self, pair, score, hashes, ids, none, weight) -> None:
        new = {"pair": pair, "score": score, "hash": hashes, "id": ids, "none": none, "weight": weight}
        all_ = {k: np.concatenate([self.pool[k], v]) for k, v in new.items()}
        order = np.lexsort((all_["hash"], all_["id"], all_["none"], -all_["score"], all_["pair"]))
        pair = all_["pair"][order]
        first = np.searchsorted(pair, pair)
        order = order[np.arange(len(order)) - first < self.keep]
        self.pool = {k: v[order] for k, v in all_.items()}

    def rows(self) -> pa.RecordBatch:
        p = self.pool
        anchor = p["pair"] // self.width
        return pa.RecordBatch.from_arrays([
            pa.array(self.hash[anchor]), self.id.combine_chunks().take(pa.array(anchor)), pa.array(self.label[anchor], pa.int32()), pa.array(self.copies[anchor]),
            pa.array((p["pair"] % self.width + 1).astype(np.int32)), pa.array(p["hash"]), pa.array(p["id"], mask=p["none"]), pa.array(p["weight"]), pa.array(p["score"])],
            ["anchor", "anchor_id", "label", "copies", "k", "hash", "vec_id", "weight", "score"])


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows["q"].combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1).astype(np.int64)


def _search(aimed: bool):
    """Passes over a partition in which each tile's anchors come first, then its rows by vec_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key, anchors = None, None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table[k].to_numpy() for k in ("tile", "length", "kind")], axis=1)
            edges = np.flatnonzero((np.diff(marks, axis=0, prepend=-1) != 0).any(axis=1)).tolist() if len(marks) else []
            for a, b in zip(edges, [*edges[1:], len(marks)]):
                here, part = tuple(marks[a, :2]), table.slice(a, b - a)
                if here != key:
                    if tile is not None:
                        yield tile.rows()
                    tile, key, anchors = None, here, []
                if marks[a, 2] == 0:
                    anchors.append(part)
                elif anchors or tile is not None:
                    if tile is None:
                        tile, anchors = _Tile(pa.concat_tables(anchors).combine_chunks(), aimed), []
                    tile.add(part)
        if tile is not None:
            yield tile.rows()
    return run


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, aimed: bool) -> DataFrame:
    """Every anchor meets every row in one tile: blocks of anchors by parts of rows, as many tiles as the session has partitions.

    A tile's rows pass by as a stream, so a tile may hold any number of them, and its result is bounded by its anchors.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_anchors // ANCHORS))
    parts = max(1, -(-tasks // blocks))
    number = lambda block, part: (block * parts + part).cast("int").alias("tile")
    block, part = F.pmod("hash", F.lit(blocks)), F.pmod(F.xxhash64("hash"), F.lit(parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["length", "hash", "vec_id", "label", "weight", "q", "aims"]
    left = anchors.withColumn("other", every(parts)).select(number(block, F.col("other")), F.lit(0).alias("kind"), *columns)
    right = rows.withColumn("other", every(blocks)).withColumn("aims", F.lit(None).cast("array<bigint>")).select(number(F.col("other"), part), F.lit(1).alias("kind"), *columns)
    spread = min(tasks, blocks * parts)
    dealt = left.unionByName(right).repartitionById(spread, F.pmod("tile", F.lit(spread)).cast("int"))
    sorted_ = dealt.sortWithinPartitions("tile", "length", "kind", F.col("vec_id").asc_nulls_last(), "hash")
    return sorted_.mapInArrow(_search(aimed), _FOUND)


def _best(found: DataFrame, n: int, *key: str) -> DataFrame:
    """The first n rows of each key by score and vec_id, copies counted each."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "hash")
    one = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("weight", F.lit(n).cast("bigint"))))).drop("copy", "weight")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def hard_negatives(vectors: DataFrame, every: int = 100) -> DataFrame:
    """For each anchor of `vectors` (vec_id, label, embedding) and each of its positives, rows of other labels nearly as close.

    Anchors are the rows whose vec_id is divisible by `every`; they meet all rows. A row's score is the inner product of the
    components times SCALE, rounded down. An anchor's positives are its first POSITIVES other rows of its label by score, ties
    by smaller vec_id; a positive's negatives are the first NEGATIVES rows of other labels whose score lies between LOW and
    HIGH per cent of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are exact: one single-precision product per prime, as many primes as the vectors' lengths call for. A first pass
    over all tiles finds the positives, a second the negatives.

    Rows with null label, vector or component, or with a component that is not finite, take no part; neither do vectors
    whose scaled length is 2**31 or more, as their scores may not fit 64 bits. Vectors of different lengths have no
    score. Null vec_id: no anchor, last among ties. Rows that repeat count each, as anchors too. Empty input: empty result.
    """
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    sound = F.col("label").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    square = F.aggregate(F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-1e18)), F.lit(1e18))).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    good = rows.where(F.coalesce(sound, F.lit(False))).where(square < LONGEST)
    classes = good.select("vec_id", "label", whole(F.col("embedding")).alias("q")).groupBy("vec_id", "label", "q").agg(F.count("*").alias("weight"))
    classes = materialize(classes.withColumns({"hash": F.xxhash64("vec_id", "label", "q"), "length": F.size("q")}), "negatives-rows")
    anchors = classes.where(F.col("vec_id") % every == 0)
    n = anchors.count()
    near = _best(_tiles(anchors.withColumn("aims", F.lit(None).cast("array<bigint>")), classes, n, False), POSITIVES, *_KEY)
    positives = materialize(near.select(*_KEY, "copies", F.col("place").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    aims = positives.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda x: x["positive_score"]).alias("aims"))
    aims = aims.toDF("hash", "vec_id", "label", "aims")
    hard = _best(_tiles(anchors.join(aims, ["hash", "vec_id", "label"]), classes, n, True), NEGATIVES, *_KEY, "k")
    hard = hard.select(*_KEY, "k", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.join(hard, [*_KEY, "k"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(label: Column, vec_id: Column, step: int = 7, labels: int = 10) -> Column:
    """The label of planted rows (vec_id divisible by `step`): the next one."""
    return F.when(F.coalesce(vec_id % step == 0, F.lit(False)), (label + 1) % labels).otherwise(label).cast("int")
