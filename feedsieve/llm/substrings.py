"""Repeated word windows across documents, found behind a count-min sketch of their anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.llm import kernels as K
from feedsieve.llm.common import row_key
from feedsieve.session import materialize

WINDOW = 50
ANCHOR = 16  # words of the hash that addresses a window's counters
DEPTH = 2  # counter rows of the sketch
ROOM = 16  # counters in each row per anchor of a document: a lone anchor is estimated repeated in about 1 of 260 cases

_SCAN = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()),
                   ("cells", pa.list_(pa.int64())), ("runs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("known", pa.list_(pa.int32())),
                      ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_RESULT = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def runs_of(w: np.ndarray, at: np.ndarray, window: int, anchor: int):
    """All windows of a slice of texts (hashes of their words or bytes), cut into runs that share the place of their smallest anchor hash.

    Returns the window hashes and, per run, its text, first window (within the slice), number of windows, cell and a
    hash of its whole content.
    """
    hashes, anchors = K.rolling(w, window), K.rolling(w, anchor, K.U64(0xC2B2AE3D27D4EB4F))
    counts = np.maximum(np.diff(at) - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    place = at[:-1][doc] + (np.arange(len(doc)) - first[:-1][doc])
    best = K.sliding_argmin(anchors, window - anchor + 1)[place] if len(place) else place
    new = np.ones(len(doc), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(doc)))
    p1, p2 = place[head], place[head] + length - 1
    cell = anchors[best[head]]
    content = K.mix(hashes[p1] ^ K.mix(hashes[p2] ^ K.mix(cell ^ length.astype(K.U64))))
    return hashes, doc[head], p1, length, cell, content


def _scan(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            for a, b in K.slices(offsets):
                part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w, _, _, at = K.words(part, inner)
                _, doc, p1, length, cell, content = runs_of(w, at, window, anchor)
                per = np.searchsorted(doc, np.arange(b - a + 1))
                raw = part.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[inner[i] : inner[i + 1]].split())).hexdigest() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("row").slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()),
                    K.lists(K.signed(cell), per, pa.int64()), K.lists(K.signed(content), per, pa.int64()),
                    K.lists((p1 - at[:-1][doc]).astype(np.int32), per, pa.int32()), K.lists(length.astype(np.int32), per, pa.int32())], schema=_SCAN)
    return run


def _windows(window: int, anchor: int):
    """Hashes of the windows in runs that are repeated only in part; covered words of the runs that are whole copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.binary(batch.column("text"))
            open_runs, known = batch.column("open").to_pylist(), batch.column("known")
            for a, b in K.slices(offsets):
                w, _, _, at = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = K.rolling(w, window)
                places, per = [], [0]
                for i in range(a, b):
                    spans = [np.arange(s, s + n) for s, n in ((x["start"], x["count"]) for x in open_runs[i] or ())]
                    mine = np.unique(np.concatenate(spans)) if spans else np.empty(0, np.int64)
                    places.append(mine + at[i - a])
                    per.append(per[-1] + len(mine))
                flat, per = np.concatenate(places).astype(np.int64), np.array(per)
                local = flat - np.repeat(at[:-1], np.diff(per))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("row").slice(a, b - a), batch.column("text").slice(a, b - a).cast(pa.string()),
                    known.slice(a, b - a).cast(pa.list_(pa.int32())), K.lists(K.signed(hashes[flat]) if len(flat) else np.empty(0, np.int64), per, pa.int64()),
                    K.lists(local.astype(np.int32), per, pa.int32())], schema=_WINDOWS)
    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, offsets = K.binary(batch.column("text"))
            known, places = batch.column("known"), batch.column("places")
            for i in range(batch.num_rows):
                found = data[offsets[i] : offsets[i + 1]].tobytes().split()
                change = np.zeros(len(found) + 1, np.int64)
                spans = np.array(known[i].as_py() or (), np.int64).reshape(-1, 2)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 0] + spans[:, 1] + window - 1, -1)
                single = np.array(places[i].as_py() or (), np.int64)
                np.add.at(change, single, 1)
                np.add.at(change, single + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join([x for x, g in zip(found, gone.tolist()) if not g])
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], schema=_RESULT)
    return run


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "string": "string", "list<item: int64>": "array<bigint>", "list<item: int32>": "array<int>", "list<element: int64>": "array<bigint>", "list<element: int32>": "array<int>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _counters(cell: str, width: int, depth: int) -> list[Column]:
    """The counter of a cell in each row of the sketch, numbered through all rows."""
    return [F.pmod(F.xxhash64(cell, F.lit(i)), F.lit(width)) + F.lit(i * width) for i in range(depth)]


def sketch(cells: DataFrame, width: int, depth: int = DEPTH) -> DataFrame:
    """Counters of a count-min sketch over `cells` (cells: the different cells of one document) that exceed one.

    Each partition adds up its own counters before the shuffle and the partitions' sums are added after it. `depth` rows of
    `width` counters are stored sparsely, without those that are 0, so no task holds a whole row.
    """
    each = cells.select(F.explode("cells").alias("cell")).select(F.explode(F.array(*_counters("cell", width, depth))).alias("counter"))
    return each.groupBy("counter").agg(F.count("*").alias("n")).where("n > 1").select("counter")


def estimated_repeated(runs: DataFrame, counters: DataFrame, width: int, depth: int = DEPTH) -> DataFrame:
    """Rows of `runs` (cell, ...) all of whose counters exceed one: the smallest is the estimate."""
    for i, counter in enumerate(_counters("cell", width, depth)):
        mine = counters.where((F.col("counter") >= i * width) & (F.col("counter") < (i + 1) * width))
        runs = runs.withColumn("counter", counter).join(mine, "counter", "left_semi").drop("counter")
    return runs


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, width: int | None = None) -> DataFrame:
    """Words of `docs` (doc_id, text) covered by a window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed and kept_sha256, one row per input row; windows are judged on the input.

    Prefilter: a count-min sketch counts, for the smallest `anchor`-word hash of each window, which all equal windows
    share, the documents that hold it. Counters only overestimate, so a window with an estimate of one is not repeated in
    another document. Its rows have `width` counters, by default `ROOM` times the anchors of all documents; a smaller
    width costs time and changes no result.
    Second pass, exact, over the windows estimated repeated: consecutive windows with one anchor travel as one run; a run whose whole
    content starts in a smaller document is covered, and only the rest is grouped window by window.

    Null text: no words. Fewer words than a window: nothing removed. Null doc_id: neither smaller nor larger than
    any, so nothing is removed there or because of it. Rows that share a doc_id are not repeats of each other; rows
    that share text too get the same result each. Windows are compared by 64-bit hashes.
    """
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    scan = materialize(rows.mapInArrow(_scan(window, anchor), _ddl(_SCAN)), "windows-scan")
    held = scan.where("doc_id IS NOT NULL AND size(cells) > 0")
    if width is None:
        width = max(1, ROOM * (held.agg(F.sum(F.size("cells"))).first()[0] or 0))
    counters = materialize(sketch(held.select(F.array_distinct("cells").alias("cells")), width), "windows-sketch")
    runs = held.select("doc_id", "row", F.inline(F.arrays_zip("cells", "runs", "starts", "counts"))).toDF("doc_id", "row", "cell", "run", "start", "count")
    runs = materialize(estimated_repeated(runs, counters, width), "windows-runs")
    firsts = materialize(runs.groupBy("run").agg(F.min("doc_id").alias("first")), "windows-firsts")
    runs = runs.join(firsts, "run").withColumn("whole", F.col("first") < F.col("doc_id"))
    spans = F.collect_set(F.when(F.col("whole"), F.struct("start", "count")))
    known = F.flatten(F.transform(F.sort_array(spans), lambda x: F.array(x["start"], x["count"])))
    of_row = runs.groupBy("row").agg(known.alias("known"), F.collect_set(F.when(~F.col("whole"), F.struct("start", "count"))).alias("open"))
    texts = rows.join(materialize(of_row, "windows-rows"), "row").select("doc_id", "row", "text", "known", "open")
    opened = materialize(texts.mapInArrow(_windows(window, anchor), _ddl(_WINDOWS)), "windows-open")
    single = opened.select("doc_id", "row", F.inline(F.arrays_zip("hashes", "places"))).toDF("doc_id", "row", "hash", "place")
    repeated = single.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    covered = single.join(materialize(repeated, "windows-repeated"), "hash").where("first < doc_id").groupBy("row").agg(F.collect_set("place").alias("places"))
    affected = opened.select("row", "text", "known").join(covered, "row", "left").where("size(known) > 0 OR size(places) > 0")
    removed = affected.mapInArrow(_remove(window), _ddl(_RESULT)).dropDuplicates(["row"])
    return scan.join(removed, "row", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
