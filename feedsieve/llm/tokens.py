"""Token ids in binary files: fixed-size blocks cut into bit or byte planes, each compressed alone, with a chunk index."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedsieve.llm import kernels as K
from feedsieve.llm.common import fresh_name
from feedsieve.session import materialize

BLOCK = 1 << 16  # ids of a chunk
FILE_IDS = 1 << 26  # a file ends with the document that reaches so many ids
READ_IDS = 1 << 22  # ids that one reading row covers, about
SLICE_BYTES = 1 << 23  # bytes of text encoded together; a longer text is encoded alone
KNOWN = 400_000  # parts of texts whose ids a task remembers
# The pattern of pieces by which texts may be encoded part by part (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAGIC = b"IDPLANE1"
KINDS = ("byte", "bit")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER = (np.arange(256) < 0x80) & ~_LETTER & ~K._SPACE

_CHUNK = np.dtype([("n", "<u4"), ("crc", "<u4"), ("offset", "<u8"), ("sizes", "<u4", 32)])
_HEAD = np.dtype([("kind", "<u4"), ("chunks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("table", "<u8")])
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])

_FILES = "partition int, number int, file string, n_docs bigint, n_ids bigint, n_chunks bigint, n_bytes bigint"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def split(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of 32-bit ids: 4 of one byte, or 32 of one bit each. A plane of zeros is empty."""
    flat = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = flat.T if kind == "byte" else np.packbits(np.unpackbits(flat, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def join(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """Ids from their planes."""
    if kind == "byte":
        flat = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            if p:
                flat[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            if p:
                bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        flat = np.packbits(bits, axis=1, bitorder="little")
    return flat.reshape(-1).view("<u4")


class Writer:
    """One file: magic, planes of all chunks, document table, chunk index, head, length of index and head, magic.

    It grows under a name of its own and gets its final one when it is whole, so a task that is run again, or twice at
    once, leaves the same file.
    """

    def __init__(self, folder: str, name: str, kind: str, block: int, level: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.kind, self.block = name, kind, block
        self.draft = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.at, self.chunks, self.tables, self.n_ids, self.n_docs = len(MAGIC), [], [], 0, 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.press = zstandard.ZstdCompressor(level=level)

    def add(self, ids: np.ndarray, table: np.ndarray) -> None:
        self.pending.append(ids)
        self.tables.append(table)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        self.n_docs += len(table)
        if self.waiting >= self.block:
            flat = np.concatenate(self.pending)
            whole = len(flat) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(flat[i : i + self.block])
            self.pending, self.waiting = [flat[whole:]], len(flat) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        entry = np.zeros((), _CHUNK)
        entry["n"], entry["crc"], entry["offset"] = len(ids), zlib.crc32(ids.tobytes()), self.at
        for i, plane in enumerate(split(ids, self.kind)):
            packed = self.press.compress(plane) if plane else b""
            self.out.write(packed)
            self.at += len(packed)
            entry["sizes"][i] = len(packed)
        self.chunks.append(entry)

    def close(self) -> dict:
        if self.waiting:
            self._chunk(np.concatenate(self.pending))
        table = self.press.compress(np.concatenate([*self.tables, np.empty(0, _ENTRY)]).tobytes())
        head = np.zeros((), _HEAD)
        head["kind"], head["chunks"], head["docs"], head["ids"], head["table"] = KINDS.index(self.kind), len(self.chunks), self.n_docs, self.n_ids, len(table)
        foot = np.array(self.chunks, _CHUNK).tobytes() + head.tobytes()
        for part in (table, foot, len(foot).to_bytes(8, "little"), MAGIC):
            self.out.write(part)
            self.at += len(part)
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.store.type_name != "local" and self.store.get_file_info(final).type != fs.FileType.NotFound:
            self.store.delete_file(final)
        self.store.move(self.draft, final)
        return {"file": self.name, "n_docs": self.n_docs, "n_ids": self.n_ids, "n_chunks": len(self.chunks), "n_bytes": self.at}


class Reader:
    """Random access to one file through its chunk index."""

    def __init__(self, folder: str, name: str):
        store, path = fs.FileSystem.from_uri(folder)
        self.name, self.file = name, store.open_input_file(f"{path}/{name}")
        tail = len(MAGIC) + 8
        size = self.file.size()
        last = self.file.read_at(tail, size - tail)
        if last[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name}: not a whole file of token ids")
        length = int.from_bytes(last[:8], "little")
        foot = self.file.read_at(length, size - tail - length)
        head = np.frombuffer(foot[-_HEAD.itemsize :], _HEAD)[0]
        self.kind = KINDS[head["kind"]]
        self.chunks = np.frombuffer(foot[: -_HEAD.itemsize], _CHUNK)
        self.first = np.concatenate([[0], np.cumsum(self.chunks["n"], dtype=np.int64)])
        packed = int(head["table"])
        table = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, size - tail - length - packed), int(head["docs"]) * _ENTRY.itemsize) if head["docs"] else b""
        self.table = np.frombuffer(table, _ENTRY)
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def chunk(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            entry = self.chunks[k]
            n, sizes = int(entry["n"]), entry["sizes"].astype(np.int64)[: 4 if self.kind == "byte" else 32]
            data, ends = self.file.read_at(int(sizes.sum()), int(entry["offset"])), np.cumsum(sizes)
            width, unpress = n if self.kind == "byte" else -(-n // 8), zstandard.ZstdDecompressor()
            planes = [unpress.decompress(data[e - s : e], width) if s else b"" for s, e in zip(sizes, ends)]
            ids = join(planes, n, self.kind)
            if zlib.crc32(ids.tobytes()) != entry["crc"]:
                raise ValueError(f"{self.name}: chunk {k} is damaged")
            self.held = (k, ids)
        return self.held[1]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last of the file; only the chunks that hold them are read."""
        parts, k = [], int(np.searchsorted(self.first, first, "right")) - 1
        while first < last:
            base = int(self.first[k])
            part = self.chunk(k)[first - base : last - base]
            parts.append(part)
            first += len(part)
            k += 1
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


class Encoder:
    """Ids of texts by a tokenizer of the `tokenizers` library, called once for each different piece of the texts.

    A tokenizer whose pieces are those of PATTERN drops white space and never looks across the edges of a piece, so a text's
    ids are those of its parts, one after another, if it is cut at such edges only: at white space, and between an ASCII
    letter and another ASCII character (but not behind an apostrophe, which may begin a piece with the letter). Parts are
    told apart by their bytes, ASCII letters lowered as the tokenizer does; not those before a character that may combine with
    them. Where a text holds one of the tokenizer's added tokens, its slice is cut at white space only and nothing is lowered.
    Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        steps = (plan.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lowers = [x.get("type") for x in (plan.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        self.by_piece = lowers and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("invert") is True
        self.model = self.tokenizer.model
        self.added = [x["content"].encode() for x in plan["added_tokens"]]
        self.known: dict[bytes, list[int]] = {}

    def _lists(self, parts: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        return [e.ids for e in found]

    def _cuts(self, text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text with letters lowered, and where its parts begin."""
        blank = K._SPACE[text]
        begin = np.ones(len(text), bool)
        begin[1:] = blank[1:] != blank[:-1]
        begin[begins[begins < len(text)]] = True
        raw = text.tobytes()
        if not any(x in raw for x in self.added):
            letter, other = _LETTER[text], _OTHER[text]
            begin[1:] |= letter[:-1] & other[1:] | other[:-1] & letter[1:] & (text[:-1] != 0x27)
            alone = np.ones(len(text), bool)
            alone[:-1] = text[1:] < 0x80
            text = np.where(alone, K._LOWER[text], text)
        return text, np.flatnonzero(begin)

    def __call__(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        data, offsets = K.binary(column)
        flats, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for a, b in K.slices(offsets, SLICE_BYTES):
            text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not self.by_piece:
                lists = self._lists([text[i:j].tobytes() for i, j in zip(at, at[1:])])
                counts.append(np.array([len(x) for x in lists], np.int64))
                flats.append(np.fromiter((i for x in lists for i in x), np.uint32, int(counts[-1].sum())))
                continue
            if not len(text):
                counts.append(np.zeros(b - a, np.int64))
                continue
            text, cut = self._cuts(text, at[:-1])
            parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(text)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]).dictionary_encode()
            names = parts.dictionary.to_pylist()
            new = [x for x in names if x not in self.known]
            if len(self.known) + len(new) > KNOWN:
                self.known, new = {}, names
            # What is one piece of small letters already goes to the tokenizer's model at once.
            plain = [x for x in new if x.isalpha() and x.islower()]
            self.known.update((x, [token.id for token in self.model.tokenize(x.decode())]) for x in plain)
            rest = [x for x in new if x not in self.known]
            self.known.update(zip(rest, self._lists(rest)))
            lists = [self.known[x] for x in names]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
            first, place = np.cumsum(size) - size, parts.indices.to_numpy()
            n = size[place]
            upto = np.concatenate([[0], np.cumsum(n)])
            flats.append(ids[np.arange(upto[-1]) + np.repeat(first[place] - upto[:-1], n)])
            counts.append(np.diff(upto[np.searchsorted(cut, at)]))
        return np.concatenate(flats), np.concatenate(counts)


@lru_cache(maxsize=1)
def _encoder(path: str, changed: int) -> Encoder:
    """One encoder a worker process, so that its tasks share the pieces it knows; a file changed since is read again."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The id `end` behind each text's ids."""
    if end is None:
        return ids, counts
    last = np.cumsum(counts) + np.arange(len(counts))
    out = np.empty(len(ids) + len(counts), np.uint32)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner], out[last] = ids, end
    return out, counts + 1


def _write(folder: str, tokenizer_path: str, end: int | None, kind: str, block: int, file_ids: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        encode, partition, number, writer = _encoder(tokenizer_path, os.stat(tokenizer_path).st_mtime_ns), TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            row = {"partition": partition, "number": number, **writer.close()}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k in ("partition", "number") else None) for k, v in row.items()})

        for batch in batches:
            ids, counts = with_end(*encode(batch.column("text")), end)
            table = np.zeros(len(counts), _ENTRY)
            doc = batch.column("doc_id")
            table["doc_id"], table["null"], table["n"] = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), counts
            ends = np.cumsum(counts)
            done = 0
            while done < len(counts):
                if writer is None:
                    writer = Writer(folder, f"part-{partition:06d}-{number:04d}.ids", kind, block, level)
                base = int(ends[done - 1]) if done else 0
                upto = min(len(counts), int(np.searchsorted(ends, base + file_ids - writer.n_ids)) + 1)
                writer.add(ids[base : int(ends[upto - 1])], table[done:upto])
                done = upto
                if writer.n_ids >= file_ids:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()
    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int | None = 1, kind: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS, level: int = 3) -> DataFrame:
    """Encode `docs` (doc_id, text) and write all ids to files in `folder`, in ascending doc_id order.

    Returns the manifest, one row per file: partition, number, file, n_docs, n_ids, n_chunks, n_bytes and start (ids of all
    files before it); it is also stored as Parquet in `folder`/manifest, for `manifest`. `end` is appended to every
    document (None: nothing).

    `folder` is a URI or path that all executors can write to. Texts are dealt by ranges of (doc_id, hash of the text, place
    in the input), so neither repeated ids nor repeated rows meet in one task; each task encodes and writes its range
    in one pass, and holds one chunk. A text must fit into a task's memory.

    Null or empty text: no ids but `end`. Null doc_id: first, kept as null. Rows with one doc_id follow each other in an
    order that depends on their texts; all are written. Empty input: no file, an empty manifest.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    spark = docs.sparkSession
    root, tie, spread = folder.rstrip("/"), fresh_name(docs, "tie"), fresh_name(docs, "spread")
    path = f"{root}/files"
    store, local = fs.FileSystem.from_uri(path)
    store.create_dir(local, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).withColumns({tie: F.xxhash64("text"), spread: F.spark_partition_id()})
    order = (F.col("doc_id").asc_nulls_first(), tie, spread)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = materialize(dealt.mapInArrow(_write(path, tokenizer_path, end, kind, block, file_ids, level), _FILES), "token-manifest")
    before = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of `folder`, as `write` returned them."""
    return spark.read.schema(_FILES + ", start bigint").parquet(f"{folder.rstrip('/')}/manifest")


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(path, row["file"])
                upto = np.concatenate([[0], np.cumsum(reader.table["n"], dtype=np.int64)])
                # A document belongs to the piece in which it begins.
                first, last = np.searchsorted(upto[:-1], [row["low"], row["high"]])
                while first < last:
                    until = min(int(last), max(int(first) + 1, int(np.searchsorted(upto, upto[first] + (1 << 20), "right")) - 1))
                    part, edges = reader.table[first:until], upto[first : until + 1]
                    ids = np.ascontiguousarray(reader.ids(int(edges[0]), int(edges[-1])), "<u4").view(np.uint8)
                    sliced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((edges - edges[0]) * 4), pa.py_buffer(ids)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], mask=part["null"] == 1), pa.array(edges[:-1] + row["start"]), pa.array(part["n"].astype(np.int64)), sliced], schema=_DOCS)
                    first = until
    return run


def read(spark: SparkSession, folder: str, read_ids: int = READ_IDS) -> DataFrame:
    """Documents from the files of `folder`: doc_id, start (ids before it in the whole set), n_tokens and ids.

    `ids` holds little-endian unsigned 32-bit integers. Each file is read in pieces of about `read_ids` ids, in as many
    tasks as the session has shuffle partitions; a piece reads only its own chunks, which are checked by their crc.
    """
    piece = F.explode(F.sequence(F.lit(0), F.col("n_ids") - 1, F.lit(read_ids)))
    pieces = manifest(spark, folder).where("n_ids > 0").select("file", "start", "n_ids", piece.alias("low"))
    pieces = pieces.select("file", "start", "low", F.least(F.col("low") + read_ids, "n_ids").alias("high"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks).mapInArrow(_read(f"{folder.rstrip('/')}/files"), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def id_list(ids: pa.Array) -> pa.Array:
    """The binary column of `read` as lists of ids, for use inside Arrow functions."""
    return pa.array([np.frombuffer(x.as_py(), "<u4") for x in ids], pa.list_(pa.uint32()))
