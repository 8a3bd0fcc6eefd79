"""Suffix-array dedup: bytes of every string of ``length`` bytes that also starts elsewhere are removed.

A suffix for each byte would be far more data than the texts. But every string of ``length`` bytes holds a
minimizer, its GRAM-byte substring of smallest hash, at a place that its bytes alone decide. So equal strings
meet at equal minimizers, and only suffixes that start at minimizers (about one byte in fifty) are looked at:

1. Which minimizer substrings occur twice anywhere? Chunks send hashes to ranges of the hash space.
2. The strings of one minimizer overlap; together they are one stretch of text, its context. A context that
   occurs twice settles all its strings. Where copies are long, this settles nearly everything.
3. What is left, contexts that are alone but share their minimizer's bytes with others, is sorted as suffixes:
   sampled splitters cut the suffixes into ranges by their leading bytes, each range is sorted by multikey
   quicksort, and the lengths of common prefixes give runs of equal strings. Runs that reach a splitter are
   compared across that boundary by the hashes of their strings.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from leafquery.functions.staging import stage
from leafquery.llm.common import _BLOCK, _powers, keyed, mix, slices, text_buffer

LENGTH = 200
BUCKET_ROWS = 20_000
RANGE_BYTES = 24_000_000
_CHUNK = 2_000_000
_PLACE = 21  # bits of a place within a block


def minimizers(buf: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """For each start of a whole string of ``length`` bytes in one document, where its minimizer is; else -1."""
    gram = length // 2
    span, n = length - gram + 1, len(buf)
    out = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    step = _BLOCK - 2 * length
    power, inverse = _powers()
    for s in range(0, n - length + 1, step):
        part = buf[s:s + step + length - 1].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[:len(part)], dtype=np.uint64)])
        k = len(part) - gram + 1
        h = mix((total[gram:] - total[:-gram]) * inverse[:k])
        # hash first, then place: the least is the leftmost of the smallest
        h = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(k, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[:width - span], h[span - width:])
        out[s:s + len(h)] = s + (h & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out[max(a, b - length + 1):b] = -1  # strings do not cross documents
    return out


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of each run of strings with one minimizer, those of no string left out."""
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
    real = at[heads] >= 0
    return heads[real], tails[real]


def gram_hashes(buf: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes at each place."""
    h = np.zeros(len(places), np.uint64)
    for j in range(gram):
        h = (h ^ (buf[places + j].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return mix(h)


def _repeated_minimizers(rows: DataFrame, length: int, ranges: int) -> DataFrame:
    """(key, places): where in each text a minimizer stands whose bytes occur elsewhere too.

    Each range of hashes gets 32 bits of a hash and its place, from every chunk. Bytes that a chunk holds
    twice are known there and sent once for the chunk, so hot bytes never come from every document. Two hashes
    that agree by chance only add a place that is compared in vain later.
    """
    mid = "chunk bigint, part bigint, places binary, hashes binary, keys binary"
    out = rows.select("key").schema.add("places", T.ArrayType(T.IntegerType()))
    whole = 0xFFFFFFFF

    def send(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, _CHUNK):
                own, off = buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                at = minimizers(own, off, length)
                places = at[runs(at)[0]].astype(np.int64)  # ascending, since a later string has no earlier minimizer
                h = gram_hashes(own, places, length // 2)
                order = np.argsort(h, kind="stable")
                h, places = h[order], places[order]
                again = h[1:] == h[:-1]
                first = np.concatenate([[True], ~again])[:len(h)]
                twice = ~first | np.concatenate([again, [False]])[:len(h)]
                known = places[twice]
                sent = np.where(twice, whole, places)[first]
                h = h[first]
                part = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                low = (h * np.uint64(ranges)) >> np.uint64(32)
                bounds = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(bounds))
                cut = [slice(bounds[r], bounds[r + 1]) for r in some]
                sink = pa.BufferOutputStream()
                keys = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(off[:-1])], ["key", "start"])
                with pa.ipc.new_stream(sink, keys.schema) as w:
                    w.write_batch(keys)
                n = len(some) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array([*some.tolist(), -1 - number], pa.int64()),
                     pa.array([*(sent[c].astype("<u4").tobytes() for c in cut), known.astype("<u4").tobytes()], pa.binary()),
                     pa.array([*(low[c].astype("<u4").tobytes() for c in cut), None], pa.binary()),
                     pa.array([None] * (n - 1) + [sink.getvalue().to_pybytes()], pa.binary())],
                    ["chunk", "part", "places", "hashes", "keys"])
                number += 1

    def answer(key, table):
        if key[0].as_py() < 0:
            return table
        hashes = [np.frombuffer(x, "<u4") for x in table["hashes"].to_pylist()]
        values = np.concatenate(hashes)
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, found = 0, []
        for x, own in zip(table["places"].to_pylist(), hashes):
            places = np.frombuffer(x, "<u4")[twice[at:at + len(own)]]
            found.append(places[places != whole].tobytes())
            at += len(own)
        return pa.table([table["chunk"], table["part"], pa.array(found, pa.binary()),
                         pa.nulls(len(table), pa.binary()), table["keys"]], ["chunk", "part", "places", "hashes", "keys"])

    def collect(key, table):
        keys = pa.ipc.open_stream(next(x for x in table["keys"].to_pylist() if x is not None)).read_all()
        start = keys["start"].to_numpy()
        places = np.sort(np.concatenate([np.frombuffer(x, "<u4") for x in table["places"].to_pylist()])).astype(np.int64)
        # of empty texts at one offset the last is meant, the one that has bytes
        doc = np.searchsorted(start, places, "right") - 1
        some, first = np.unique(doc, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()),
                                         pa.array((places - start[doc]).astype(np.int32)))
        return pa.table([keys["key"].combine_chunks().take(pa.array(some)), lists], ["key", "places"])

    return (rows.select("key", "text").mapInArrow(send, mid).groupBy("part").applyInArrow(answer, mid)
            .groupBy("chunk").applyInArrow(collect, out))


def multikey_sort(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: each step sorts by eight more bytes, only within ties so far."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)  # group of each place of ``order``
    tied = np.arange(n)  # places that aren't alone in their group
    for k in range(words.shape[1]):
        if not len(tied):
            break
        own = words[order[tied], k]
        by = np.lexsort((own, group[tied]))
        order[tied] = order[tied][by]
        own, old = own[by], group[tied]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (old[1:] != old[:-1])])
        heads = np.flatnonzero(new)
        group[tied] = tied[heads][np.cumsum(new) - 1]  # a group is named by its first place
        sizes = np.diff(np.append(heads, len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, sizes


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of a and b, at most ``most``."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, most)


class _Runs:
    """Rows in sorted order with common prefix lengths: which rows agree in their first d bytes."""

    def __init__(self, strings: list[bytes], width: int):
        self.bytes, self.sizes = _matrix(strings, width)
        self.order = multikey_sort(self.bytes)
        s, z = self.bytes[self.order], self.sizes[self.order]
        self.lcp = _common(s[1:], s[:-1], np.minimum(z[1:], z[:-1])) if len(s) else np.zeros(0, np.int64)

    def classes(self, depth: int) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum(self.lcp < depth)])[:len(self.order)]
        return out


def sort_bucket(right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, length: int,
                below: bytes | None, above: bytes | None):
    """(repeated, open_): booleans for row and i, the bytes that a string has before its minimizer.

    A string is left[:i] backwards and right[:length - i]. It is repeated if another row of the bucket has
    both parts; it is open if its right part equals the beginning of a splitter of the bucket, so that
    rows beyond the splitter may have it too.
    """
    most = length - length // 2
    suffixes, before = _Runs(right, length), _Runs(left, most)
    near = np.zeros(len(right), np.int64)
    for edge in (below, above):
        if edge is not None:
            other, size = _matrix([edge[:length]], length)
            near = np.maximum(near, _common(suffixes.bytes, np.repeat(other, len(right), 0), np.minimum(suffixes.sizes, size[0])))
    repeated = np.zeros((len(right), most + 1), bool)
    open_ = np.zeros((len(right), most + 1), bool)
    for i in range(most + 1):
        rows = np.flatnonzero((low <= i) & (i <= high))
        if not len(rows):
            continue
        open_[rows, i] = near[rows] >= length - i
        both = suffixes.classes(length - i)[rows] * np.int64(len(right) + 1) + before.classes(i)[rows]
        _, which, n = np.unique(both, return_inverse=True, return_counts=True)
        repeated[rows, i] = n[which] > 1
    return repeated, open_


def _suffix_repeats(parts: DataFrame, length: int, bucket_rows: int) -> DataFrame:
    """(uid, first, last): starts of repeated strings, from contexts (uid, at, right, left, low, high, alone)."""
    n = parts.count()
    buckets = max(1, -(-n // bucket_rows))
    # a few candidates for each splitter, the same at every run
    sample = parts.orderBy(F.xxhash64("uid", "at"), "uid", "at").limit(16 * buckets if buckets > 1 else 0)
    ranked = sorted((bytes(r.right), bytes(r.left)) for r in sample.select("right", "left").collect())
    edges = sorted({ranked[k * len(ranked) // buckets] for k in range(1, buckets)}) if ranked else []
    sent = parts.sparkSession.sparkContext.broadcast(edges)

    def bucket(right: pa.Array, left: pa.Array) -> pa.Array:
        return pa.array([bisect_right(sent.value, x) for x in zip(right.to_pylist(), left.to_pylist())], pa.int64())

    schema = "uid bigint, at bigint, i bigint, j bigint, string binary"

    def run(key, table):
        b, cuts = key[0].as_py(), sent.value
        right, left = table["right"].to_pylist(), table["left"].to_pylist()
        uid, at = table["uid"].to_numpy(), table["at"].to_numpy()
        alone = table["alone"].to_numpy(zero_copy_only=False)
        repeated, open_ = sort_bucket(right, left, table["low"].to_numpy(), table["high"].to_numpy(), length,
                                      cuts[b - 1][0] if b > 0 else None, cuts[b][0] if b < len(cuts) else None)
        repeated &= alone[:, None]
        pad = np.zeros((len(right), 1), bool)
        turns = np.diff(np.concatenate([pad, repeated, pad], 1).astype(np.int8), axis=1)
        (r, i), (_, j) = np.nonzero(turns == 1), np.nonzero(turns == -1)
        ro, io = np.nonzero(open_)
        strings = [hashlib.blake2b(left[x][:k][::-1] + right[x][:length - k], digest_size=16,
                                   salt=int(k).to_bytes(8, "little")).digest() for x, k in zip(ro.tolist(), io.tolist())]
        rows = np.concatenate([r, ro])
        return pa.table([pa.array(uid[rows]), pa.array(at[rows]), pa.array(np.concatenate([i, io])),
                         pa.array(np.concatenate([j - 1, io])), pa.array([None] * len(r) + strings, pa.binary())],
                        ["uid", "at", "i", "j", "string"])

    found = stage(parts.withColumn("bucket", F.arrow_udf(bucket, "bigint")("right", "left"))
                  .groupBy("bucket").applyInArrow(run, schema))
    across = found.filter("string is not null")
    twice = stage(across.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string"))
    every = found.filter("string is null").union(across.join(twice, "string", "left_semi").select(found.columns))
    return every.select("uid", (F.col("at") - F.col("j")).alias("first"), (F.col("at") - F.col("i")).alias("last"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): each text's bytes, its removed spans and the bytes that stay.

    Every byte is removed that lies in a string of ``length`` (even, 16 at least) bytes which also
    starts at any other place, of the same document or another; overlapping places count. Strings are
    judged on the input. ``spans`` is array<struct<start, stop>> of maximal removed runs, ``kept`` the
    other bytes as binary. Texts are UTF-8 bytes; null is empty; texts below ``length`` lose nothing.
    Equal rows are copies of each other. Other columns are left out.
    """
    rows = keyed(docs, id_col, text_col).select("id", "key", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = _repeated_minimizers(rows, length, max(16, -(-size // RANGE_BYTES)))
    # repeated rows have one key; each of them gets all places found for it
    places = places.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    base = stage(rows.join(places, "key", "left").select("id", "text", "places")
                 .withColumn("uid", F.monotonically_increasing_id()))
    texts = base.filter("places is not null")
    gram = length // 2

    def contexts(batches):
        for batch in batches:
            uid, gram_hash, a, first, last, one, two = [], [], [], [], [], [], []
            for k in range(batch.num_rows):
                buf, offsets = text_buffer(batch.column(1).slice(k, 1))
                at = minimizers(buf, offsets, length)
                heads, tails = runs(at)
                own = np.isin(at[heads], batch.column(2)[k].values.to_numpy())
                heads, tails = heads[own], tails[own]
                text = buf.tobytes()
                for p, q, m in zip(heads.tolist(), tails.tolist(), at[heads].tolist()):
                    digest = hashlib.blake2b(text[p:q + length], digest_size=16).digest()
                    one.append(int.from_bytes(digest[:8], "little", signed=True))
                    two.append(int.from_bytes(digest[8:], "little", signed=True))
                gram_hash.append(gram_hashes(buf, at[heads], gram).view(np.int64))
                uid.append(np.full(len(heads), batch.column(0)[k].as_py()))
                a.append(at[heads].astype(np.int64))
                first.append(heads)
                last.append(tails)
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (uid, gram_hash, a, first, last)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(one, pa.int64()),
                                              pa.array(two, pa.int64())], ["uid", "gram", "at", "first", "last", "c1", "c2"])

    found = stage(texts.select("uid", "text", "places").mapInArrow(
        contexts, "uid bigint, gram bigint, at bigint, first bigint, last bigint, c1 bigint, c2 bigint"))
    kinds = stage(found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at", "first", "last", "gram")).alias("r")))
    settled = kinds.filter("n > 1").select("c1", "c2")
    # grams with a context of its own and at least one more
    needy = stage(kinds.groupBy(F.col("r.gram").alias("gram")).agg(F.count("*").alias("k"), F.min("n").alias("least"))
                  .filter("k > 1 and least = 1").select("gram"))
    need = (kinds.select("r.*", (F.col("n") == 1).alias("alone")).join(needy, "gram", "left_semi")
            .groupBy("uid").agg(F.collect_list(F.struct("at", "first", "last", "alone")).alias("want")))

    def cut(batches):
        for batch in batches:
            out = []
            for uid, text, want in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for w in want:
                    at = w["at"]
                    out.append({"uid": uid, "at": at, "right": data[at:w["last"] + length],
                                "left": data[w["first"]:at][::-1], "low": at - w["last"], "high": at - w["first"],
                                "alone": w["alone"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema(
                [("uid", pa.int64()), ("at", pa.int64()), ("right", pa.binary()), ("left", pa.binary()),
                 ("low", pa.int64()), ("high", pa.int64()), ("alone", pa.bool_())]))

    parts = stage(texts.select("uid", "text").join(need, "uid").mapInArrow(
        cut, "uid bigint, at bigint, right binary, left binary, low bigint, high bigint, alone boolean"))
    starts = (found.join(stage(settled), ["c1", "c2"]).select("uid", "first", "last")
              .union(_suffix_repeats(parts, length, bucket_rows)))
    spans = starts.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("starts"))

    def finish(batches):
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                own: list[list[int]] = []
                for a, b in sorted((s["first"], s["last"] + length) for s in starts or []):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                edges = [0, *(x for s in own for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in own])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    schema = base.select("id").schema.add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))).add("kept", "binary")
    cut_up = texts.join(spans, "uid", "left").select("id", "text", "starts").mapInArrow(finish, schema)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    whole = base.filter("places is null").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return whole.union(cut_up)
