"""Best-fit packing: token pieces of documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leafquery.functions.staging import stage
from leafquery.llm.tokens import encoder, text_lists

CAPACITY = 2048
OPEN_BINS = 16_384


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = 0,
                 with_ids: bool = False, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and an end id, cut to ``capacity``.

    Only texts longer than the capacity are cut, from their end, so that the first piece alone may be
    shorter. ``start`` counts the document's ids before the piece. A null text is the empty text:
    one piece with the end id. Repeated rows give repeated pieces; other columns are left out. An empty
    table gives no pieces. A text of any length is encoded whole, in the memory of one task. Ids are those
    of ``encode(text, add_special_tokens=False)``, so a literal special token in a text is its one id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for texts in text_lists(batch.column(1)):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, code in enumerate(enc.encode(texts)):
                    code += end
                    n, p, k = len(code) // 4, 0, 0
                    stop = n % capacity or capacity
                    while p < n:
                        rows.append(at + i)
                        piece.append(k)
                        start.append(p)
                        length.append(stop - p)
                        part = code[4 * p:4 * stop]
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        p, stop, k = stop, stop + capacity, k + 1
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                names = ["id", "piece", "start", "length", "ids_crc32", "ids"][:len(out)]
                yield pa.RecordBatch.from_arrays(out, names)
                at += len(texts)
        enc.words.older = {}  # the worker goes on with other work and needs the memory

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class BestFit:
    """Online best fit with a fixed number of open bins.

    ``spaces`` is a bitset with bit f set while some open bin has f tokens free; the lowest set bit
    from the wanted length upwards is the best fit. When too many bins are open, the fullest (lowest
    set bit) is closed.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.spaces, self.bins = 0, [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item."""
        fits = self.spaces >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.bins[left].append(bin_)
            self.spaces |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset, every sequence at most ``capacity`` long and gapless.

    The number of partitions follows the total length, so that one holds about as many sequences as
    bins may be open. A partition is read longest piece first, in a total order of its rows, so a
    task that runs again after a loss packs alike. No more than the open bins are held in memory.
    """
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-tokens // (capacity * open_bins)))
    order = [F.desc("length"), *[F.asc(c) for c in pieces.columns if c != "length"]]
    # dealt by their places in the table, so that many equal rows go to many partitions
    dealt = pieces.repartition(parts, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [fit.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()),
                 pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                   tokenizer_path: str | None = None, with_ids: bool = False, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for all of ``docs``.

    The pieces are written out first, since their total length decides the number of partitions and
    texts should be encoded once. See ``token_pieces`` for empty, null and repeated rows.
    """
    pieces = stage(token_pieces(docs, capacity, tokenizer_path, with_ids=with_ids, id_col=id_col, text_col=text_col))
    return pack(pieces, capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the token arrays themselves, from ``pack_documents(with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), "length"))
