"""Quality classifier: an additive model with pairwise interactions over statistics of whole texts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafquery.llm.common import hash_words, slices, text_buffer, window_hashes

FEATURES = ("log_words", "word_bytes", "symbols", "upper", "digits", "punctuation", "pipes", "shouts", "non_ascii",
            "line_ends", "repeated_windows", "distinct_words", "repeated_lines", "symbol_words", "stray_bytes")
TRAIN_ROWS = 12_000
_SLICE = 2_000_000


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_CLASSES = {"symbols": _lut(b"#*$%&<>~^@\\{}[]_=+"), "upper": _lut(bytes(range(65, 91))), "digits": _lut(b"0123456789"),
            "punctuation": _lut(b".,;:'\"()-?"), "pipes": _lut(b"|"), "shouts": _lut(b"!"),
            "non_ascii": _lut(bytes(range(128, 256))), "line_ends": _lut(b"\n"),
            "stray_bytes": _lut(bytes([*range(9), 11, 12, *range(14, 32), 127]))}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: occurrences of values that it has more than once, and its distinct values."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    again = np.concatenate([[False], same])
    twice = again | np.concatenate([same, [False]])
    return np.bincount(d[twice], minlength=n_docs), np.bincount(d[~again], minlength=n_docs)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; shares are 0 for empty texts."""
    buf, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)), np.float32)
    at = {name: k for k, name in enumerate(FEATURES)}
    for a, b in slices(offsets, _SLICE):
        base, off, n = offsets[a], offsets[a:b + 1] - offsets[a], b - a
        part, own = buf[base:offsets[b]], out[a:b]
        size = np.maximum(np.diff(off), 1)
        for name, lut in _CLASSES.items():
            own[:, at[name]] = _per_doc(lut[part], off) / size
        starts, words, first = hash_words(part, off)
        count = np.diff(first)
        doc = np.repeat(np.arange(n), count)
        many = np.maximum(count, 1)
        own[:, at["log_words"]] = np.log1p(count)
        own[:, at["word_bytes"]] = np.diff(off) / many
        if len(words):
            odd = _CLASSES["symbols"][part] | _CLASSES["shouts"][part] | _CLASSES["pipes"][part]
            total = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
            ends = np.append(starts[1:], len(part))
            own[:, at["symbol_words"]] = np.bincount(doc, total[ends] > total[starts], n) / many
            own[:, at["distinct_words"]] = _repeats(doc, words, n)[1] / many
        windows = window_hashes(words, 8)
        if len(windows):
            inside = doc[:len(windows)] == doc[7:]
            own[:, at["repeated_windows"]] = _repeats(doc[:len(windows)][inside], windows[inside], n)[0] / many
        # lines as hashes of their words, so that blank lines don't count as repeats
        if len(words):
            line = np.searchsorted(np.flatnonzero(part == 10), starts)
            new = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
            heads = np.flatnonzero(new)
            place = np.arange(len(words)) - np.repeat(heads, np.diff(np.append(heads, len(words))))
            sums = np.add.reduceat(words * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), heads)
            lines = np.bincount(doc[heads], minlength=n)
            own[:, at["repeated_lines"]] = 1 - _repeats(doc[heads], sums, n)[1] / np.maximum(lines, 1)
            own[:, at["repeated_lines"]][lines == 0] = 0
    return out


@dataclass
class Model:
    """Per-feature and per-pair lookup tables over bins; a score is a sum of table entries."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[fine[:, k]]
        for i, j, t in self.pairs:
            total += t[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, depth: int, penalty: float) -> tuple[np.ndarray, float]:
    """Newton step of a tree over ordered bins: split where it gains most, then each side again."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    step = np.full(len(grad), g[-1] / (h[-1] + penalty))
    if depth == 0 or len(grad) < 2:
        return step, 0.0
    left = g[:-1] ** 2 / (h[:-1] + penalty)
    right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + penalty)
    gain = left + right - g[-1] ** 2 / (h[-1] + penalty)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= 1e-9:
        return step, 0.0
    a, more_a = _shallow_tree(grad[:cut], hess[:cut], depth - 1, penalty)
    b, more_b = _shallow_tree(grad[cut:], hess[cut:], depth - 1, penalty)
    return np.concatenate([a, b]), float(gain[cut - 1]) + more_a + more_b


def _quadrants(grad: np.ndarray, hess: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts of a two-dimensional table, and the Newton step of its four parts."""
    best = (-1.0, 0, 0)
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    for i in range(len(grad) - 1):
        a, b = g[i, :-1], h[i, :-1]
        c, d = g[i, -1] - a, h[i, -1] - b
        e, f = g[-1, :-1] - a, h[-1, :-1] - b
        k, m = g[-1, -1] - a - c - e, h[-1, -1] - b - d - f
        gain = a ** 2 / (b + penalty) + c ** 2 / (d + penalty) + e ** 2 / (f + penalty) + k ** 2 / (m + penalty)
        j = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[j] > best[0]:
            best = (float(gain[j]), i + 1, j + 1)
    out = np.zeros_like(grad)
    for rows in (slice(0, best[1]), slice(best[1], None)):
        for cols in (slice(0, best[2]), slice(best[2], None)):
            out[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + penalty)
    return out, best[0]


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40,
        n_pairs: int = 6, rate: float = 0.1, depth: int = 2, penalty: float = 5.0) -> Model:
    """Cyclic boosting: each round gives every feature in turn one shallow tree on its bins.

    Main effects come first; the pairs whose best quadrants gain most on what is left are then boosted
    likewise. Without rows, or with one class only, the model is a constant.
    """
    model = Model([_edges(x[:, k], bins) if len(x) else np.zeros(0) for k in range(x.shape[1])],
                  [_edges(x[:, k], coarse) if len(x) else np.zeros(0) for k in range(x.shape[1])])
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(mean / (1 - mean)))
    if not len(x) or y.min() == y.max():
        return model
    fine, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step, _ = _shallow_tree(np.bincount(fine[:, k], g, len(table)), np.bincount(fine[:, k], h, len(table)),
                                    depth, penalty)
            table += rate * step
            total += rate * step[fine[:, k]]

    def pair_step(i, j):
        g, h = slopes()
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = rough[:, i] * shape[1] + rough[:, j]
        return _quadrants(*(np.bincount(cell, s, shape[0] * shape[1]).reshape(shape) for s in (g, h)), penalty)

    ranked = sorted(((pair_step(i, j)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step, _ = pair_step(i, j)
            table += rate * step
            total += rate * step[rough[:, i], rough[:, j]]
    return model


def is_held_out(doc_id: Column) -> Column:
    """True for a third of the ids, whose labels are never learned from; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, *, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``train_rows`` labelled rows that are not held out, chosen by a hash of their id.

    The chosen labels are broadcast (their number is that parameter), so no text is shuffled.
    """
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
              .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("id")))
              .orderBy(F.xxhash64("id"), "id", "y").limit(train_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # one row for each label, however many rows share its id
    rows = (texts.select("id", "y", features_udf()(F.col("text")).alias("x"))
            .groupBy("id", "y").agg(F.min("x").alias("x")).collect())
    rows = sorted((r.y, *r.x) for r in rows)  # the order must not depend on the cluster
    data = np.array(rows, np.float64).reshape(len(rows), 1 + len(FEATURES))
    return fit(data[:, 1:], data[:, 0])


def features_udf():
    def run(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    return F.arrow_udf(run, "array<float>")


def scorer(model: Model):
    """Column function text -> score between 0 and 1, higher where a text is likelier of label 1."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts).astype(np.float64)))
    return F.arrow_udf(run, "double")


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, *, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(row, held_out, score): the score of every whole text.

    Null and empty texts get the score of a text without words. Rows without a label are scored like
    the others; labels, other columns and the id are no inputs of the score, so repeated rows score alike.
    """
    model = train(docs, labels, train_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    return docs.select(F.struct("*").alias("row"), is_held_out(F.col(id_col)).alias("held_out"),
                       scorer(model)(F.col(text_col)).alias("score"))
