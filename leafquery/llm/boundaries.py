"""Token ids as files: one id after the other, with document boundaries and ids in Elias-Fano form.

A shard file holds, in ascending order of document id, the token ids of its documents without any separator
(two bytes an id where the vocabulary allows it, else four), then two non-decreasing sequences: where each
document ends, and which document it is. Both are Elias-Fano coded: ``low_bits`` bits of a value as they are, the
rest as a bit set with one 1 a value, and the place of each 256th 1 in 32 bits, so that the i-th value is found
without a table of 64-bit offsets. About ``2 + log2(ids / documents)`` bits a document.

Files are written by tasks next to the tables of a run, under a name of the attempt and then renamed, so
a task that runs again leaves the same file; only files named in the manifest are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafquery.functions.staging import shared_folder, stage
from leafquery.llm.tokens import encoder, text_lists

END_ID = 2
SHARD_IDS = 16_000_000
SHARD_DOCS = 1_000_000
_SAMPLE = 256
_READ_IDS = 4_000_000
_MAGIC = b"EFIDS1\0\0"
_TRAILER = struct.Struct("<QQQQqQ8s")  # bytes an id, ids, documents, null ids, first id, start of the index, magic
_HEAD = struct.Struct("<QQQQ")  # values, low bits, words of low bits, words of the bit set


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def build(values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        high[ones] = 1
        bits = np.empty((n, low_bits), np.uint8)
        for j in range(low_bits):
            bits[:, j] = (values >> np.uint64(j)).astype(np.uint8) & 1
        flat = np.packbits(bits.ravel(), bitorder="little")
        low = np.zeros(-(-len(flat) // 8) * 8, np.uint8)
        low[:len(flat)] = flat
        return EliasFano(n, low_bits, low.view("<u8"), np.packbits(high, bitorder="little").view("<u8"),
                         ones[::_SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high))
        pad = b"\0" * (-self.samples.nbytes % 8)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes() + pad

    @staticmethod
    def frombytes(data: bytes, at: int) -> tuple["EliasFano", int]:
        """The sequence that begins at byte ``at``, and where it ends."""
        n, low_bits, n_low, n_high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low = np.frombuffer(data, "<u8", n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + 8 * n_low)
        at += 8 * (n_low + n_high)
        n_samples = -(-n // _SAMPLE)
        samples = np.frombuffer(data, "<u4", n_samples, at)
        return EliasFano(n, low_bits, low, high, samples), at + -(-4 * n_samples // 8) * 8

    def select(self, i: int) -> int:
        """Value ``i``: from its sample on, whole words of the bit set are passed by their number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        at = place // 64
        word = int(self.high[at]) >> (place % 64) << (place % 64)
        while (ones := word.bit_count()) <= left:
            left -= ones
            at += 1
            word = int(self.high[at])
        for _ in range(left):
            word &= word - 1
        high = at * 64 + (word & -word).bit_length() - 1 - i
        if not self.low_bits:
            return high
        a = i * self.low_bits
        low = int(self.low[a // 64]) >> (a % 64)
        if a % 64 + self.low_bits > 64:
            low |= int(self.low[a // 64 + 1]) << (64 - a % 64)
        return (high << self.low_bits) | (low & ((1 << self.low_bits) - 1))

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low.view(np.uint8), count=self.n * self.low_bits, bitorder="little")
            bits = bits.reshape(self.n, self.low_bits)
            for j in range(self.low_bits):
                out |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class _Shard:
    """A file that is being written: ids go out as they come, the index at the end."""

    def __init__(self, folder: str, name: str, width: int):
        self.folder, self.name, self.width = folder, name, width
        self.files, self.root = _open(folder)
        self.files.create_dir(self.root, recursive=True)
        self.tries = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.tries)
        self.ids, self.n_ids, self.ends = [], 0, []

    def add(self, doc_id: int | None, code: bytes) -> None:
        ids = np.frombuffer(code, "<u4")
        self.out.write(ids.astype("<u2").tobytes() if self.width == 2 else code)
        self.n_ids += len(ids)
        self.ids.append(doc_id)
        self.ends.append(self.n_ids)

    def close(self) -> tuple:
        """Manifest row of the file."""
        known = [i for i in self.ids if i is not None]  # null ids come first
        first = known[0] if known else 0
        self.out.write(b"\0" * (-self.n_ids * self.width % 8))
        index = self.n_ids * self.width + -self.n_ids * self.width % 8
        self.out.write(EliasFano.build(np.array(self.ends, np.uint64)).tobytes())
        self.out.write(EliasFano.build(np.array(known, np.int64).astype(np.uint64) - np.uint64(first % (1 << 64))).tobytes())
        self.out.write(_TRAILER.pack(self.width, self.n_ids, len(self.ids), len(self.ids) - len(known), first, index, _MAGIC))
        self.out.close()
        self.files.move(self.tries, f"{self.root}/{self.name}")
        return f"{self.folder}/{self.name}", len(self.ids), self.n_ids, self.ids[0], self.ids[-1]


class ShardReader:
    """Documents of one shard file. The index is read at once, ids only where they are asked for."""

    def __init__(self, path: str):
        files, name = _open(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        self.width, self.n_ids, self.n_docs, nulls, first, index, magic = _TRAILER.unpack(
            self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != _MAGIC:
            raise ValueError(f"no file of token ids: {path}")
        data = self.file.read_at(size - _TRAILER.size - index, index)
        self.ends, at = EliasFano.frombytes(data, 0)
        self.names, _ = EliasFano.frombytes(data, at)
        self.nulls, self.first = nulls, first

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.names.select(i - self.nulls) + self.first

    def span(self, i: int) -> tuple[int, int]:
        """(first, end) of document ``i`` among the ids of the file, by two selects."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file as unsigned 32-bit numbers."""
        data = self.file.read_at((end - first) * self.width, first * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.read(*self.span(i))

    def find(self, doc_id: int) -> range:
        """Places of the documents with this id (none, one, or several for repeated rows)."""
        def bound(least: int) -> int:
            a, b = self.nulls, self.n_docs
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if self.doc_id(mid) < least else (a, mid)
            return a
        return range(bound(doc_id), bound(doc_id + 1))

    def documents(self) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of documents, first, end, token ids) of consecutive slices of documents."""
        ends = self.ends.values().astype(np.int64)
        names = self.names.values()
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[:len(ends)]
        a = 0
        while a < self.n_docs:
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + _READ_IDS, "right")))
            known = (names[max(a - self.nulls, 0):max(b - self.nulls, 0)] + np.uint64(self.first % (1 << 64))).astype(np.int64)
            ids = [None] * max(0, min(b, self.nulls) - a) + known.tolist()
            yield ids, starts[a:b], ends[a:b], self.read(int(starts[a]), int(ends[b - 1]))
            a = b


def write_ids(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, tokenizer_path: str | None = None,
              shard_ids: int = SHARD_IDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``; returns the manifest of the files.

    Ids of documents are whole numbers. The manifest has (path, start, n_docs, n_ids, first_id, last_id): files in ascending order of document id,
    ``start`` being the number of ids in all files before. A task writes the files of one range of
    document ids and begins a new file after ``shard_ids`` ids, so files stay small however large a range is.
    Rows with one id come in the order of a hash of their texts; equal rows are dealt over ranges by their place
    in the table. A null id comes first and stays null, a null text is the empty text (only
    the end id), a text of any length is held whole by one task. An empty table gives no files. Other
    columns are left out. Ids are those of ``encode(text, add_special_tokens=False)``.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("place"))
    order = [F.asc_nulls_first("id"), "tie"]
    ranges = max(1, rows.rdd.getNumPartitions())  # as many as the scan has: they follow the size of the input

    def run(batches):
        enc, part, shard, k = encoder(tokenizer_path), TaskContext.get().partitionId(), None, 0
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()

        def closed():
            path, n_docs, n_ids, first, last = shard.close()
            return pa.RecordBatch.from_pylist([{"part": part, "k": k, "path": path, "n_docs": n_docs, "n_ids": n_ids,
                                                "first_id": first, "last_id": last}], out)

        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in text_lists(batch.column(1)):
                for code in enc.encode(texts):
                    shard = shard or _Shard(folder, f"part-{part:06d}-{k:06d}.efids", width)
                    shard.add(ids[at], code + end)
                    at += 1
                    if shard.n_ids >= shard_ids or len(shard.ids) >= SHARD_DOCS:
                        yield closed()
                        shard, k = None, k + 1
        if shard:
            yield closed()
        enc.words.older = {}

    out = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                     ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    files = stage(rows.repartitionByRange(ranges, *order, "place").sortWithinPartitions(*order).mapInArrow(
        run, "part int, k int, path string, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"))
    # the running sum over ranges has one row a range; within a range, files follow each other
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", _before("total", Window.orderBy("part")).alias("base"))
    inside = _before("n_ids", Window.partitionBy("part").orderBy("k"))
    return stage(files.withColumn("start", inside).join(before, "part").select(
        "path", (F.col("start") + F.col("base")).alias("start"), "n_docs", "n_ids", "first_id", "last_id"))


def _before(name: str, order) -> Column:
    return F.coalesce(F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files of ``manifest``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is that of all the document's ids, end id
    included, as little-endian unsigned 32-bit numbers. A task reads whole files in slices of some million ids.
    """
    fields = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for ids, starts, ends, codes in ShardReader(path).documents():
                    cuts = list(zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist()))
                    out = [pa.array(ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts),
                           pa.array([zlib.crc32(codes[a:b]) for a, b in cuts], pa.int64())]
                    if with_ids:
                        out.append(pa.array([codes[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, schema=schema)

    kinds = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    # a file is about one task's work; the manifest itself is small enough to be one partition
    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files, "path").mapInArrow(run, kinds)

