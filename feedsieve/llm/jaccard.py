"""Near-duplicate documents: a Jaccard join on shingles by parity sketches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm import kernels as K
from feedsieve.llm.common import components, row_key
from feedsieve.session import discard, materialize

SHINGLE = 5
PERCENT = 75
SAMPLE = 8000  # documents that tell which shingles are frequent
OFTEN = 3  # documents of the sample from which on a shingle is frequent
MAX_HEAVY = 1 << 16
PER_BUCKET = 500_000  # signatures of a bucket, about
CHUNK = 1_000_000  # signatures that a task holds before it hands them on

PART = 2048  # members of one side of a tile of a large group, about

SMALLEST, RATIO = 64, 8  # sets below SMALLEST are sketched with one block per shingle; bands grow by RATIO

_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("heavy", pa.list_(pa.int64())), ("sketch", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BLOBS = pa.schema([("bucket", pa.int32()), ("signatures", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_MEMBERS = pa.schema([("signature", pa.int64()), ("doc_id", pa.int64())])


def band_of(n: int) -> int:
    """0 below SMALLEST, then one band for each factor RATIO."""
    band, top = 0, SMALLEST
    while n >= top:
        band, top = band + 1, top * RATIO
    return band


def signatures(found: np.ndarray, heavy: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Block signatures of one set of shingle hashes (sorted), and which of them are frequent.

    The sketch of a band is a long string of parity bits: each shingle flips one bit, chosen by its hash. So the
    Hamming distance of two sketches is at most the symmetric difference of the sets. It is kept sparsely: the string
    is cut into blocks, and a block's value is the XOR of the hashes of its set bits. With similarity p the symmetric
    difference of sets of s and t shingles is at most d = (100-p)(s+t)/(100+p), so at most d of a set's non-zero blocks
    can differ. Of any d+1 blocks chosen by one order for all sets, two similar sets share at least one (pigeonhole);
    frequent blocks come last in that order.
    """
    n = len(found)
    if not n:
        return np.empty(0, K.U64), np.empty(0, bool)
    own, out, often = band_of(n), [], []
    known = heavy[np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)] == found if len(heavy) else np.zeros(n, bool)
    for band in {own, band_of(-(-n * percent // 100))}:
        partner = n * 100 // percent if band == own else SMALLEST * RATIO**band - 1
        d = (100 - percent) * (n + partner) // (100 + percent)
        if band == 0:
            values, common = found, known
        else:
            blocks = (found >> K.U64(32)) * K.U64(SMALLEST * RATIO**band) >> K.U64(32)
            head = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            values, common = np.bitwise_xor.reduceat(found, head), np.logical_and.reduceat(known, head)
            values, common = K.mix(values ^ K.mix(blocks[head] + K.U64(1)))[values != 0], common[values != 0]
        if len(values) <= d:
            raise ValueError("a parity sketch has too few blocks in use; raise RATIO or SMALLEST")
        values = K.mix(values ^ K.U64(0x5851F42D4C957F2D * (band + 1) % (1 << 64)))
        pick = np.lexsort((values, common))[: d + 1]
        out.append(values[pick])
        often.append(common[pick])
    return np.concatenate(out), np.concatenate(often)


def sketch_bits(n: int) -> int:
    """Length of the parity sketch of a set of n shingles: a power of two, at least 2 n and 64."""
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity bits of a set: each shingle flips the bit its hash names. Packed in 64-bit words."""
    bits = np.bincount((found & K.U64(sketch_bits(len(found)) - 1)).astype(np.int64), minlength=sketch_bits(len(found))) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(K.U64)


def fold(rows: np.ndarray) -> np.ndarray:
    """Sketches of half the length: those of the same sets, as the upper half of the positions wraps around."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def most_apart(n, m, percent: int):
    """Largest symmetric difference of sets of n and m shingles that are similar enough."""
    return (100 - percent) * (n + m) // (100 + percent)


def possible(n: np.ndarray, sketches: list[np.ndarray], apart: np.ndarray, percent: int, left: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets that sizes and sketches do not exclude, among those with different values of `apart`.

    With `left`, only pairs of which just one is marked.
    """
    order = np.argsort(n, kind="stable")
    length = np.array([len(x) for x in sketches])
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in np.unique(length):
        at = order[length[order] == size]
        tables[int(size)] = (at, np.stack([sketches[i] for i in at]), n[at])
    for size, (at, rows, sizes) in tables.items():
        for wide in (size, 2 * size):
            if wide not in tables:
                continue
            others, shown, larger = tables[wide]
            shown = shown if wide == size else fold(shown)
            for k, i in enumerate(at):
                first = k + 1 if wide == size else 0
                last = int(np.searchsorted(larger, sizes[k] * 100 // percent, "right"))
                if first < last:
                    j = others[first:last]
                    good = apart[j] != apart[i]
                    if left is not None:
                        good &= left[j] != left[i]
                    if good.any():
                        differ = np.bitwise_count(shown[first:last][good] ^ rows[k]).sum(axis=1)
                        for x in j[good][differ <= most_apart(sizes[k], larger[first:last][good], percent)]:
                            yield int(i), int(x)


def _sample(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in K.shingles(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(found), pa.int64())], ["shingle"])
    return run


def _sets(size: int, percent: int, heavy: np.ndarray):
    """Size and two digests of each set, and its frequent signatures. A set seen before in the task gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc, found in zip(ids, K.shingles(batch.column("text"), size)):
                x, y = int(np.bitwise_xor.reduce(found)) if len(found) else 0, int(K.mix(found).sum(dtype=K.U64)) if len(found) else 0
                values = np.empty(0, K.U64)
                if doc is not None and (len(found), x, y) not in seen:
                    seen.add((len(found), x, y))
                    values, often = signatures(found, heavy, percent)
                    values = values[often]
                out.append((doc, len(found), x - (x >> 63 << 64), y - (y >> 63 << 64), K.signed(values), sketch(found).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SETS)], schema=_SETS) if out else pa.RecordBatch.from_pylist([], _SETS)
    return run


def _light(size: int, percent: int, heavy: np.ndarray, buckets: int):
    """The other signatures, packed by bucket: five bytes each, then the documents and how many each has."""
    def pack(found: list[np.ndarray], docs: list[int]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(found)
        owner = np.repeat(np.arange(len(docs)), [len(v) for v in found])
        bucket = ((values >> K.U64(32)) * K.U64(buckets) >> K.U64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        values, owner, bucket = values[order], owner[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        ids, rows = np.array(docs, np.int64), []
        for b in range(buckets):
            part = slice(ends[b], ends[b + 1])
            if part.start < part.stop:
                holders, counts = np.unique(owner[part], return_counts=True)
                five = K.mix(values[part]).view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((b, five.tobytes(), ids[holders].tobytes(), counts.astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOBS)], schema=_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found, docs, held = set(), [], [], 0
        for batch in batches:
            for doc, shingles in zip(batch.column("doc_id").to_pylist(), K.shingles(batch.column("text"), size)):
                key = (len(shingles), int(np.bitwise_xor.reduce(shingles))) if len(shingles) else None
                if doc is None or key is None or key in seen:
                    continue
                seen.add(key)
                values, often = signatures(shingles, heavy, percent)
                found.append(values[~often])
                docs.append(doc)
                held += len(found[-1])
                if held >= CHUNK:
                    yield from pack(found, docs)
                    found, docs, held = [], [], 0
        if held:
            yield from pack(found, docs)
    return run


def _repeated(table: pa.Table) -> pa.Table:
    """(signature, doc_id) of the signatures of a bucket that more than one document has."""
    five = np.frombuffer(b"".join(x.as_py() for x in table["signatures"]), np.uint8).reshape(-1, 5)
    values = np.zeros((len(five), 8), np.uint8)
    values[:, :5] = five
    bucket = table["bucket"][0].as_py()
    values = values.reshape(-1).view(np.int64) | (bucket << 40)
    ids = np.frombuffer(b"".join(x.as_py() for x in table["docs"]), np.int64)
    docs = np.repeat(ids, np.frombuffer(b"".join(x.as_py() for x in table["counts"]), np.int32))
    order = np.argsort(values, kind="stable")
    values, docs = values[order], docs[order]
    same = values[1:] == values[:-1]
    keep = np.append(same, False) | np.append(False, same)
    return pa.Table.from_arrays([pa.array(values[keep]), pa.array(docs[keep])], schema=_MEMBERS)


def _near(percent: int):
    """Pairs whose sketches are close enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sketch_a"), batch.column("sketch_b"))):
                x, y = np.frombuffer(x.as_py(), K.U64)[None], np.frombuffer(y.as_py(), K.U64)[None]
                while x.shape[1] != y.shape[1]:
                    x, y = (fold(x), y) if x.shape[1] > y.shape[1] else (x, fold(y))
                keep[i] = np.bitwise_count(x ^ y).sum() <= most_apart(n[0, i], n[1, i], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _tiles(percent: int):
    """Pairs of a group's members that are in different components and whose sketches are close enough."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("signature", "ascending"), ("low", "ascending"), ("high", "ascending")])
        key = np.stack([table[c].to_numpy() for c in ("signature", "low", "high")])
        cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist() + [table.num_rows]
        ids, n, apart, part = (table[c].to_numpy() for c in ("doc_id", "n_shingles", "c", "part"))
        raw, out = table["sketch"].to_pylist(), set()
        for first, last in zip(cuts[:-1], cuts[1:]):
            own = slice(first, last)
            left = None if key[1, first] == key[2, first] else part[own] == key[1, first]
            for i, j in possible(n[own], [np.frombuffer(x, K.U64) for x in raw[own]], apart[own], percent, left):
                a, b = int(ids[first + i]), int(ids[first + j])
                out.add((min(a, b), max(a, b)))
        return pa.Table.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=_PAIRS)
    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(K.shingles(batch.column("text_a"), size), K.shingles(batch.column("text_b"), size)):
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(bool(both) and 100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, sample: int = SAMPLE) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of `percent` / 100 or more.

    `docs` has doc_id and text. Words are lower-cased (A-Z); a set has the distinct `size`-word shingles, or the whole
    sequence as one if there are fewer words. Returns doc_id, n_shingles and component_id (smallest linked doc_id, itself
    included), one row per input row.

    Candidates are documents that share a block signature of their parity sketches (see `signatures`). Of a signature's
    group, first all members meet its smallest document, then only members that are not connected by then meet each
    other, in tiles of about PART members, so that no group is one task and no link between components is missed. A pair
    that the sizes or the Hamming distance of the bit sketches exclude goes no further; for the others the whole
    sets (64-bit shingle hashes) are compared exactly.

    Which shingles are frequent is learnt from about `sample` documents; this changes the order of blocks and thereby the
    cost, never the result. Frequent signatures travel as plain rows, whose groups Spark can split; the others are packed.
    Buckets are handled one by one in as many tasks as the session has shuffle partitions.

    Null text, no words: empty set, linked with nothing. Null doc_id: not linked, component null. Rows that share a
    doc_id are one node of the graph. Empty input: empty result.
    """
    spark, run = docs.sparkSession, f"jaccard-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    n = docs.count()
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1))))
    often = few.mapInArrow(_sample(size), "shingle bigint").groupBy("shingle").count().where(F.col("count") >= OFTEN)
    heavy = np.sort(np.array([r[0] for r in often.orderBy(F.desc("count"), "shingle").limit(MAX_HEAVY).collect()], np.int64).view(K.U64))
    sets = materialize(docs.mapInArrow(_sets(size, percent, heavy), "doc_id bigint, n_shingles bigint, x bigint, y bigint, heavy array<bigint>, sketch binary"), f"{run}/sets")

    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(max(1, -(-total * (100 - percent) * 2 // (100 + percent) // PER_BUCKET)))
    packed = docs.mapInArrow(_light(size, percent, heavy, buckets), "bucket int, signatures binary, docs binary, counts binary")
    light = packed.groupBy("bucket").applyInArrow(_repeated, "signature bigint, doc_id bigint")
    frequent = sets.select(F.explode("heavy").alias("signature"), "doc_id")
    members = materialize(light.unionByName(frequent).distinct(), f"{run}/found/members")
    groups = members.groupBy("signature").agg(F.min("doc_id").alias("a"), F.count("*").alias("m"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).where("m > 1")
    # Signatures with the same members say the same.
    groups = materialize(groups.groupBy("a", "m", "who").agg(F.min("signature").alias("signature")).drop("who"), f"{run}/found/groups")
    members = materialize(members.join(groups, "signature"), f"{run}/grouped")
    discard(spark, f"{run}/found")

    # Equal sets are one class, linked through its smallest document.
    classes = sets.where("n_shingles > 0").groupBy("n_shingles", "x", "y").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").drop("z")
    same = sets.select("doc_id", "n_shingles", "x", "y").join(materialize(classes, f"{run}/classes"), ["n_shingles", "x", "y"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    same = materialize(same, f"{run}/same")
    # Rows that share a doc_id but not their text keep a sketch each.
    sketches = sets.where("n_shingles > 0").select("doc_id", "n_shingles", "sketch").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough."""
        pairs = materialize(pairs, f"{run}/verify/pairs")
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{run}/verify/wanted")
        texts = materialize(docs.join(wanted, "doc_id").distinct(), f"{run}/verify/texts")
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        found = materialize(both.mapInArrow(_verify(size, percent), "a bigint, b bigint").distinct(), f"{run}/links")
        discard(spark, f"{run}/verify")
        return found

    stars = materialize(members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), f"{run}/stars")
    sized = stars.join(sketches.toDF("a", "n_a", "sketch_a"), "a").join(sketches.toDF("b", "n_b", "sketch_b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    links = same.unionByName(linked(sized.mapInArrow(_near(percent), "a bigint, b bigint").distinct()))
    known = materialize(components(links, run).toDF("doc_id", "c"), f"{run}/components")

    placed = materialize(members.where("m > 2").join(known, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), f"{run}/placed")
    mixed = placed.groupBy("signature").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("signature")
    # The smallest member has met all others.
    rest = placed.where("doc_id <> a").join(materialize(mixed, f"{run}/mixed"), "signature").join(sketches, "doc_id")
    parts = F.ceil(F.col("m") / PART).cast("int")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rest = rest.select("signature", "doc_id", "c", "n_shingles", "sketch", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("signature", "low", "high"), F.lit(4 * buckets)).cast("int"))
    apart = rest.groupBy("bucket").applyInArrow(_tiles(percent), "a bigint, b bigint").distinct()
    links = links.unionByName(linked(apart))
    final = materialize(components(links, run).toDF("doc_id", "component_id"), f"{run}/result")
    result = sets.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    # The narrow result is stored; what led to it is not needed any more.
    result = materialize(result, "jaccard")
    discard(spark, run)
    return result
