"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leafquery.llm.common import hash_words, mix, slices, text_buffer

# 1: the word counts, 0: it is ignored. For every item length of 8 words or more and any fifth of the
# words of a window replaced, one of these masks lies on equal words somewhere (tests enumerate it).
MASKS = ("110111", "11010011", "11111")
WINDOW = 20
LEAST_WORDS = 5
FUZZY_WORDS = 8
BLOCK_BYTES = 8_000_000
_SLICE = 2_000_000


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each position at which the whole mask fits; words under a 0 don't count."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h)


class Seeds:
    """Seeds of one block of benchmark items: hash -> (item, word position), and the items' words."""

    def __init__(self, texts: list[str], ids: list, window: int, share: float):
        buf, offsets = text_buffer(pa.array(texts, pa.string()))
        _, self.words, self.first = hash_words(buf, offsets)
        self.ids, self.window, self.share = ids, window, share
        found = []
        for i in range(len(texts)):
            words = self.words[self.first[i]:self.first[i + 1]]
            if len(words) < LEAST_WORDS:
                continue
            for m, mask in enumerate(MASKS):
                h = seed_hashes(words, mask)
                found.append(np.stack([h, np.full(len(h), i, np.uint64), np.arange(len(h), dtype=np.uint64),
                                       np.full(len(h), m, np.uint64)]))
        table = np.concatenate(found, 1) if found else np.zeros((4, 0), np.uint64)
        self.by_mask = []
        for m in range(len(MASKS)):
            own = table[:, table[3] == m]
            own = own[:, np.argsort(own[0], kind="stable")]
            bits = max(10, int(own.shape[1]).bit_length() + 4)
            there = np.zeros(1 << bits, bool)
            there[own[0] >> np.uint64(64 - bits)] = True
            self.by_mask.append((own[0], own[1].astype(np.int64), own[2].astype(np.int64), there, np.uint64(64 - bits)))

    def candidates(self, words: np.ndarray):
        """(position, item, item position) of equal seeds."""
        for mask, (hashes, items, places, there, shift) in zip(MASKS, self.by_mask):
            h = seed_hashes(words, mask)
            at = np.flatnonzero(there[h >> shift]) if len(h) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = hi - lo
            if n.sum():
                k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield np.repeat(at, n), items[k], places[k]

    def verify(self, doc: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """(start, n_words, n_equal) of the item laid over the document at ``shift``, or None.

        Some window of the item of ``window`` words (the whole item where it is shorter) must have
        the wanted share of its words equal; items below FUZZY_WORDS words must be equal throughout.
        """
        own = self.words[self.first[item]:self.first[item + 1]]
        a, b = max(0, -shift), min(len(own), len(doc) - shift)
        equal = np.zeros(len(own) + 1, np.int64)
        equal[a + 1:b + 1] = own[a:b] == doc[a + shift:b + shift]
        total = np.cumsum(equal)
        w = min(self.window, len(own))
        best = (total[w:] - total[:-w]).max()
        need = w if len(own) < FUZZY_WORDS else int(np.ceil(self.share * w - 1e-9))
        return (a + shift, b - a, int(total[-1])) if best >= need else None

    def hits(self, column: pa.Array) -> pa.Array:
        """list<struct> of hits of each text."""
        buf, offsets = text_buffer(column)
        doc, item, start, size, equal, counts = [], [], [], [], [], np.zeros(len(offsets) - 1, np.int64)
        for a, b in slices(offsets, _SLICE):
            base = offsets[a]
            _, words, first = hash_words(buf[base:offsets[b]], offsets[a:b + 1] - base)
            pairs = set()
            for at, it, place in self.candidates(words):
                d = np.searchsorted(first, at, "right") - 1
                pairs.update(zip(d.tolist(), it.tolist(), (at - first[d] - place).tolist()))
            best: dict[tuple[int, int], tuple] = {}
            for d, i, shift in pairs:
                found = self.verify(words[first[d]:first[d + 1]], i, shift)
                if found:  # the best place of the item in the text; ties: the first
                    best[d, i] = min(best.get((d, i), found), found, key=lambda x: (-x[2], x[0]))
            for (d, i), found in sorted(best.items()):
                doc.append(a + d)
                item.append(i)
                start.append(found[0])
                size.append(found[1])
                equal.append(found[2])
        np.add.at(counts, doc, 1)
        values = pa.StructArray.from_arrays(
            [self.ids.take(pa.array(item, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
             pa.array(equal, pa.int64())], ["item_id", "start", "n_words", "n_equal"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _finder(sent, kind: T.DataType):
    def run(texts: pa.Array) -> pa.Array:
        return sent.value.hits(texts)
    return F.arrow_udf(run, kind)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: Column, *, window: int = WINDOW, share: float = 0.8,
                   item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> Column:
    """Column of array<struct<item_id, start, n_words, n_equal>>: benchmark items found in ``text``.

    The benchmark is taken in blocks of about ``block_bytes`` bytes, each a broadcast of that size
    and one pass over the text column; there is no limit on the number of blocks.
    """
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    kind = benchmark.schema[item_col].dataType
    out = T.ArrayType(T.StructType().add("item_id", kind).add("start", "long").add("n_words", "long")
                      .add("n_equal", "long"))
    found = []
    for n in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).orderBy("id", "text").collect()
        if not own:
            continue
        ids = pa.array([r.id for r in own])
        sent = docs.sparkSession.sparkContext.broadcast(Seeds([r.text for r in own], ids, window, share))
        found.append(_finder(sent, out)(text))
    return F.concat(*found) if found else F.array().cast(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """(row, hits): every document with the benchmark items found in it.

    Texts are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. An item is found where, laid word on
    word over the text, a window of 20 of its words (all words of a shorter item) has at least 0.8
    of them equal; substituted words don't hide it. Items of 5 to 7 words must be equal throughout;
    items of fewer words, or null, are evidence of nothing. Null and empty texts have no hits. Equal
    items and repeated rows are each reported. An empty benchmark finds nothing.
    """
    hits = benchmark_hits(docs, benchmark, F.col(text_col), **options)
    return docs.select(F.struct("*").alias("row"), hits.alias("hits"))
