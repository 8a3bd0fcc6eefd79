"""Language identification by a byte convolutional network, trained in numpy on labelled texts.

Filters of widths 2, 3 and 4 run over bytes, are max-pooled over fixed windows of a text, and a softmax
layer gives each window's languages. A filter on bytes is a sum of table entries, one for each byte of its
width; for scoring the tables of neighbouring bytes are merged, so a position costs three look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafquery.llm.common import slices, text_buffer

WINDOW = 256
FILTERS = 8
CLASSES = 64  # of bytes: the most frequent 62, all others, and padding (0)
WIDTHS = (2, 3, 4)
ROWS_PER_LANG = 600
_SLICE = 1_000_000


def windows(buf: np.ndarray, offsets: np.ndarray, byte_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes of shape (n, WINDOW), first window of each text): whole texts, the last window padded with 0."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // WINDOW))
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    flat[np.arange(len(buf)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], size)] = byte_class[buf]
    return flat.reshape(-1, WINDOW), first


@dataclass
class Network:
    langs: list[str]
    byte_class: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, CLASSES, FILTERS)
    weights: np.ndarray  # (pooled filters, langs)
    bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where it is (training)."""
        best, where = [], []
        for w, table in zip(WIDTHS, self.filters):
            t = WINDOW - w + 1
            total = sum(table[j][x[:, j:j + t]] for j in range(w))
            at = total.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables by pairs of bytes: (pair at t, all filters), (byte at t + 2, width 3), (pair at t + 2, width 4)."""
        two, three, four = self.filters
        pair = [(f[0][:, None] + f[1][None]).reshape(-1, FILTERS) for f in (two, three, four)]
        return (np.concatenate(pair, 1).astype(np.float32), three[2].astype(np.float32),
                (four[2][:, None] + four[3][None]).reshape(-1, FILTERS).astype(np.float32))

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        """Softmax of every window, a block of windows at a time."""
        at, byte, after = tables or self.merged()
        out = np.zeros((len(x), len(self.langs)))
        for a in range(0, len(x), 256):
            own = x[a:a + 256].astype(np.int32)
            pairs = own[:, :-1] * CLASSES + own[:, 1:]
            t = WINDOW - 3
            total = at[pairs[:, :t]]
            total[..., FILTERS:2 * FILTERS] += byte[own[:, 2:t + 2]]
            total[..., 2 * FILTERS:] += after[pairs[:, 2:t + 2]]
            logits = np.maximum(total.max(1), 0) @ self.weights + self.bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[a:a + 256] = e / e.sum(1, keepdims=True)
        return out

    def predict(self, column: pa.Array) -> pa.Array:
        """struct<lang, score> of each text: the mean over all its windows; ``und`` without a letter."""
        buf, offsets = text_buffer(column)
        langs, scores, tables = [], [], self.merged()
        for a, b in slices(offsets, _SLICE):
            x, first = windows(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], self.byte_class)
            mean = np.add.reduceat(self.probabilities(x, tables), first[:-1], 0) / np.diff(first)[:, None]
            best = mean.argmax(1)
            for i, k in enumerate(best.tolist()):
                text = buf[offsets[a + i]:offsets[a + i + 1]]
                known = has_letter(text)
                langs.append(self.langs[k] if known else UNKNOWN)
                scores.append(float(mean[i, k]) if known else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])


UNKNOWN = "und"


def has_letter(text: np.ndarray) -> bool:
    low = text | 32
    if ((low >= 97) & (low <= 122) & (text < 128)).any():
        return True
    return any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def fit(texts: list[bytes], langs: list[str], *, epochs: int = 12, rate: float = 0.05, seed: int = 0,
        windows_per_text: int = 2, batch: int = 128) -> Network:
    """Adagrad on the cross-entropy; a filter learns only at the place where its response was largest."""
    names = sorted(set(langs))
    counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    byte_class = np.full(256, 1, np.uint8)
    byte_class[np.argsort(-counts, kind="stable")[:CLASSES - 2]] = np.arange(2, CLASSES)
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, lang in zip(texts, langs):
        buf = np.frombuffer(text, np.uint8)
        own, _ = windows(buf, np.array([0, len(buf)]), byte_class)
        for k in rng.permutation(len(own))[:windows_per_text]:
            # short pieces too: cut some windows, as texts of a few words are
            w = own[k].copy()
            if rng.random() < 0.3:
                w[int(rng.integers(12, WINDOW)):] = 0
            x.append(w)
            y.append(names.index(lang))
    x, y = np.array(x), np.array(y)
    total = FILTERS * len(WIDTHS)
    net = Network(names, byte_class, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS],
                  rng.normal(0, 0.3, (total, len(names))), np.zeros(len(names)))
    seen = [np.full(f.shape, 1e-2) for f in net.filters]
    seen_w, seen_b = np.full(net.weights.shape, 1e-2), np.full(net.bias.shape, 1e-2)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            pooled, where = net.pooled(x[rows])
            active = np.maximum(pooled, 0)
            logits = active @ net.weights + net.bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ net.weights.T) * (pooled > 0)
            g = active.T @ p
            seen_w += g * g
            net.weights -= rate * g / np.sqrt(seen_w)
            g = p.sum(0)
            seen_b += g * g
            net.bias -= rate * g / np.sqrt(seen_b)
            for k, w in enumerate(WIDTHS):
                own, at = back[:, k * FILTERS:(k + 1) * FILTERS], where[:, k * FILTERS:(k + 1) * FILTERS]
                g = np.zeros_like(net.filters[k])
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x[rows], at + j, 1), np.arange(FILTERS)[None]), own)
                seen[k] += g * g
                net.filters[k] -= rate * g / np.sqrt(seen[k])
    return net


def is_held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids, whose languages are never learned from; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", most_langs: int = 200, text_bytes: int = 4 * WINDOW) -> Network | None:
    """Fit on about ``rows_per_lang`` rows of each language that are not held out, or None without any.

    Rows are chosen by a hash of id and text, with a rate for each language that follows its count. Of a
    chosen text, a run of ``text_bytes`` bytes from a hashed place is learned from, so the sample is bounded
    by ``most_langs`` (the most frequent) x ``rows_per_lang`` x ``text_bytes``. Scoring reads whole texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~is_held_out(F.col("id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not counts:
        return None
    rates = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_lang / r["count"])))])
    h = F.xxhash64("id", "text")
    part = F.substr("text", (F.pmod(F.shiftright(h, 20), F.greatest(F.length("text") - text_bytes // 2, F.lit(1))) + 1).cast("int"),
                    F.lit(text_bytes))
    chosen = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * F.get(F.array(rates), F.lit(0))[F.col("lang")])
    # equal rows are learned from once, so a text of a third of all rows can't fill the sample
    sample = sorted((r["lang"], r["part"]) for r in chosen.select("lang", part.alias("part")).distinct()
                    .limit(2 * most_langs * rows_per_lang).collect())
    if not sample:
        return None
    return fit([t.encode() for _, t in sample], [x for x, _ in sample])


def identify(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, *, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(row, held_out, lang_pred, score): the language of every whole text.

    Null texts and texts without a letter are ``und`` with score 0; so are all texts where nothing can be
    learned from. ``lang``, id and other columns are no inputs of a prediction. Repeated rows are alike.
    """
    net = train(docs, rows_per_lang, id_col=id_col, text_col=text_col, lang_col=lang_col)
    base = docs.select(F.struct("*").alias("row"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    if net is None:
        return base.select("row", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: pa.Array) -> pa.Array:
        return sent.value.predict(texts)

    return (base.withColumn("found", F.arrow_udf(run, "struct<lang:string,score:double>")("text"))
            .select("row", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")))
