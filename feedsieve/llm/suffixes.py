"""Removal of byte strings that repeat anywhere, by merging Burrows-Wheeler transforms of candidate segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm import bwt
from feedsieve.llm import kernels as K
from feedsieve.llm.common import row_key
from feedsieve.llm.substrings import runs_of
from feedsieve.session import materialize

WINDOW = 200
ANCHOR = 64  # bytes of the hash that places a window
FILTER_BITS = 26  # size of the bitmap of repeated anchors (8 MB)
BUCKET_BYTES = 1 << 17  # segment bytes whose transforms are merged in one group, about
MANY = 4096  # segments of one anchor from which on its windows are told apart one by one

_CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
_RUNS = pa.schema([("cell", pa.int64()), ("run", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])
_OPEN = pa.schema([("row", pa.int64()), ("text", pa.string()), ("known", pa.list_(pa.int32())), ("cells", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
                   ("starts", pa.list_(pa.int32())), ("segments", pa.list_(pa.binary())), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("shares", pa.list_(pa.int64()))])
_PLACES = pa.schema([("row", pa.int64()), ("places", pa.list_(pa.int32()))])
_RESULT = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


PIECE = 1 << 22  # windows of a long text that are looked at together


def _bytes(data: np.ndarray) -> np.ndarray:
    return K.BYTE[data]


def _runs(data: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple:
    """Text, first window, number of windows, cell and content of every run. A run of a long text ends with its piece."""
    if len(data) <= PIECE + window:
        return runs_of(_bytes(data), at, window, anchor)[1:]
    found = []
    for i in range(len(at) - 1):
        for s in range(at[i], max(at[i + 1] - window + 1, at[i]), PIECE):
            part = data[s : min(s + PIECE + window - 1, at[i + 1])]
            doc, first, *rest = runs_of(_bytes(part), np.array([0, len(part)]), window, anchor)[1:]
            found.append((doc + i, first + s, *rest))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5)) if found else runs_of(_bytes(data[:0]), np.zeros(2, np.int64), window, anchor)[1:]


def _cells(window: int, anchor: int):
    """Anchors of each batch and in how many places they lead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            found = [_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, anchor)[3] for a, b in K.slices(offsets)]
            cell, n = np.unique(np.concatenate(found) if found else np.empty(0, K.U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(cell)), pa.array(n, pa.int64())], schema=_CELLS)
    return run


def _candidates(window: int, anchor: int, bitmap: np.ndarray):
    """Runs of windows whose anchor may be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            row = batch.column("row").to_numpy()
            for a, b in K.slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                doc, first, length, cell, content = _runs(data[offsets[a] : offsets[b]], at, window, anchor)
                bit = (cell >> K.U64(64 - FILTER_BITS)).astype(np.int64)
                some = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(K.signed(cell[some])), pa.array(K.signed(content[some])), pa.array(row[a:b][doc[some]]),
                    pa.array((first - at[:-1][doc])[some].astype(np.int32)), pa.array(length[some].astype(np.int32))], schema=_RUNS)
    return run


def _open(window: int):
    """Bytes of the segments to merge, and window hashes of the anchors with many of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            todo, out = batch.column("todo").to_pylist(), []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                cells, weights, starts, segments, hashes, places, shares = [], [], [], [], [], [], []
                for x in todo[i] or ():
                    s, n = x["start"], x["count"]
                    piece = text[s : s + n + window - 1]
                    if x["many"]:
                        hashes += K.signed(K.rolling(_bytes(piece), window)).tolist()
                        places += range(s, s + n)
                        shares += [x["weight"]] * n
                    else:
                        cells.append(x["cell"])
                        weights.append(x["weight"])
                        starts.append(s)
                        segments.append(piece.tobytes())
                out.append((cells, weights, starts, segments, hashes, places, shares))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text").cast(pa.string()), batch.column("known").cast(pa.list_(pa.int32()))] + [pa.array([x[k] for x in out], _OPEN.field(k + 3).type) for k in range(7)], schema=_OPEN)
    return run


def _merge(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        segments, weights, starts = table["segment"].to_pylist(), table["weight"].to_numpy(), table["start"].to_numpy()
        counts = np.array([len(s) for s in segments], np.int64) - window + 1
        found = bwt.repeated(segments, counts, weights, window)
        some = [i for i, x in enumerate(found) if len(x) and weights[i] == 1]
        row = table["row"].to_numpy()
        return pa.Table.from_arrays([pa.array(row[some]), pa.array([found[i] + starts[i] for i in some], pa.list_(pa.int32()))], schema=_PLACES)
    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            known, places, out = batch.column("known"), batch.column("places"), []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                change = np.zeros(len(text) + 1, np.int64)
                spans = np.array(known[i].as_py() or (), np.int64).reshape(-1, 2)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 0] + spans[:, 1] + window - 1, -1)
                single = np.array(places[i].as_py() or (), np.int64)
                np.add.at(change, single, 1)
                np.add.at(change, single + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                starts = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[:1].any())
                out.append((int(gone.sum()), int(starts), hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("row")] + [pa.array([x[k] for x in out], _RESULT.field(k + 1).type) for k in range(3)], schema=_RESULT)
    return run


_DDL = {"int64": "bigint", "int32": "int", "string": "string", "binary": "binary"}


def ddl(schema: pa.Schema) -> str:
    """The schema in Spark's words."""
    return ", ".join(f"{f.name} " + (f"array<{_DDL[str(f.type.value_type)]}>" if pa.types.is_list(f.type) else _DDL[str(f.type)]) for f in schema)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Bytes of `docs` (doc_id, text) covered by a `window`-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts; overlaps and repeats inside a text count; strings are judged on the
    input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, one row per input row.

    A window's anchor is its smallest `anchor`-byte hash; equal windows have equal anchors, so windows whose anchor leads
    only one run of windows are unrepeated, and equal windows always meet in their anchor's bucket. Equal runs become one
    segment with a weight. The segments of a bucket are sharded; each shard's Burrows-Wheeler transform is built on its own, and
    the transforms are merged by refining their interleave: after window / 8 refinements its intervals hold the
    suffixes with `window` bytes in common, and an interval of more than one is a repeated string. Anchors with more
    than MANY different segments, which one bucket could not hold, have their windows told apart by hash, with sums added
    up before the shuffle.

    Null text: empty. Shorter than a window: nothing removed. Null doc_id is passed on. Rows that repeat a text, whatever their
    ids, repeat each other. Empty input: empty result. Anchors, runs and windows of crowded anchors are compared by 64-bit hashes.
    """
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    long = rows.where(F.octet_length("text") >= window)
    cells = long.mapInArrow(_cells(window, anchor), ddl(_CELLS)).groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.shiftrightunsigned("cell", 64 - FILTER_BITS) + 1  # bitmap functions count from 1
    pages = cells.select(F.bitmap_bucket_number(bit).alias("page"), F.bitmap_bit_position(bit).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for page in pages.collect():  # at most 2**26 bits, whatever the input
        bitmap[(page["page"] - 1) * 4096 : page["page"] * 4096] = np.frombuffer(page["bits"], np.uint8)
    runs = materialize(long.select("row", "text").mapInArrow(_candidates(window, anchor, bitmap), ddl(_RUNS)), "bytes-runs")
    classes = runs.groupBy("cell", "run").agg(F.count("*").alias("weight"), F.min(F.struct("row", "start", "count")).alias("at"))
    classes = materialize(classes.select("cell", "run", "weight", "at.*"), "bytes-classes")
    several = classes.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1")
    open_ = classes.join(materialize(several, "bytes-cells"), "cell").select("row", "start", "count", "cell", "weight", (F.col("k") > MANY).alias("many"))
    open_ = materialize(open_, "bytes-open")
    whole = runs.join(materialize(classes.where("weight > 1").select("cell", "run"), "bytes-whole"), ["cell", "run"]).select("row", "start", "count")
    todo = whole.select("row", F.struct("start", "count").alias("span"), F.lit(None).alias("x")).unionByName(
        open_.select("row", F.lit(None).alias("span"), F.struct("start", "count", "cell", "weight", "many").alias("x")))
    known = F.flatten(F.transform(F.collect_set("span"), lambda s: F.array(s["start"], s["count"])))
    of_row = materialize(todo.groupBy("row").agg(known.alias("known"), F.collect_list("x").alias("todo")), "bytes-rows")
    texts = long.join(of_row, "row").select("row", "text", "known", "todo").mapInArrow(_open(window), ddl(_OPEN))
    texts = materialize(texts, "bytes-texts")

    total = open_.where("NOT many").agg(F.sum(F.col("count") + window - 1)).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    segments = texts.select("row", F.inline(F.arrays_zip("cells", "weights", "starts", "segments"))).toDF("row", "cell", "weight", "start", "segment")
    segments = segments.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int"))
    merged = segments.groupBy("bucket").applyInArrow(_merge(window), ddl(_PLACES))
    crowded = texts.select("row", F.inline(F.arrays_zip("hashes", "places", "shares"))).toDF("row", "hash", "place", "share")
    twice = crowded.groupBy("hash").agg(F.sum("share").alias("n")).where("n > 1").select("hash")
    single = crowded.where("share = 1").join(materialize(twice, "bytes-twice"), "hash").select("row", F.array("place").alias("places"))
    covered = merged.unionByName(single).groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))
    affected = texts.select("row", "text", "known").join(covered, "row", "left").where("size(known) > 0 OR size(places) > 0")
    removed = affected.mapInArrow(_remove(window), ddl(_RESULT)).dropDuplicates(["row"])
    whole_text = rows.select("doc_id", "row", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return whole_text.join(removed, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
