"""A trained encoder: token vectors from a truncated decomposition of weighted co-occurrence counts.

Counts of tokens that stand near each other become a sparse symmetric matrix of positive pointwise mutual
information. Its leading eigenvectors come from randomised subspace iteration: a block of ``dimension`` + ``extra`` columns is
a table with one row a token, a product with the matrix is a join and a sum, and only Gram matrices of the
block's width go through the driver. A text's vector is the weighted mean of its tokens' vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import forget, stage
from ..functions.text import tokenize

WINDOW = 5
LEAST = 5
EXTRA = 8
STEPS = 6
#: bytes of token vectors that may be broadcast
BROADCAST_BYTES = 32 << 20
#: known tokens that may be broadcast to the pairs
BROADCAST_TOKENS = 1_000_000
#: tokens that are paired at once, and pairs that are held before they are counted
_TOKENS_HELD = 1 << 18
_PAIRS_HELD = 1 << 22
#: of a larger table, only tokens that occur this often are broadcast, and no more of them than fit
RARE_WEIGHT = 1e-3


@dataclass
class TokenVectors:
    """tokens(token, n, weight, vec): occurrences, weight in a text, vector; ``width`` numbers a vector."""

    tokens: DataFrame
    width: int

    def write(self, path: str, shards: int = 16) -> None:
        """Parquet, hashed by token to ``shards`` files."""
        self.tokens.repartition(shards, "token").write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "TokenVectors":
        tokens = spark.read.parquet(path)
        first = tokens.select(F.size("vec")).first()
        return TokenVectors(tokens, first[0] if first else 0)


def _numbered_pairs(batches: Iterator[pa.RecordBatch], known: pa.Array, window: int,
                    tokens_held: int = _TOKENS_HELD, pairs_held: int = _PAIRS_HELD) -> Iterator[pa.RecordBatch]:
    """(pair, n) from lists of tokens: both places in ``known`` as one number, the smaller first; counted in parts of bounded size."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        lists = batch.column(0)
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        for first in range(0, len(at), tokens_held):
            for far in range(1, window + 1):
                a, b = slice(first, min(first + tokens_held, len(at) - far)), slice(first + far, first + far + tokens_held)
                if a.stop <= a.start:
                    break
                x, y = at[a], at[b]
                both = (x >= 0) & (y >= 0) & (text[a] == text[b])
                x, y = x[both], y[both]
                held.append(np.minimum(x, y) << 32 | np.maximum(x, y))
                size += len(x)
            if size > pairs_held:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def pair_counts(texts: DataFrame, text_col: str = "text", window: int = WINDOW, known: DataFrame | None = None) -> DataFrame:
    """(x, y, n): how often two tokens stand at most ``window`` apart, x <= y. Counted inside each text, summed map-side.

    With ``known`` (token) only pairs of these. Where they can be broadcast, tokens become numbers, so that a pair is one number
    before it is counted and shuffled.
    """
    lists = texts.select(tokenize(F.col(text_col)).alias("_t"))
    few = None if known is None else known.limit(BROADCAST_TOKENS + 1).toArrow().column(0).combine_chunks()
    if few is not None and len(few) <= BROADCAST_TOKENS:
        spark = texts.sparkSession
        # in the order of their bytes, which is that of strings here
        few = pa.array(sorted(set(few.to_pylist()) - {None}), pa.string())
        shared = spark.sparkContext.broadcast(few)
        counts = (lists.filter(F.col("_t").isNotNull())
                  .mapInArrow(lambda batches: _numbered_pairs(batches, shared.value, window), "pair long, n long")
                  .groupBy("pair").agg(F.sum("n").alias("n")))
        names = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(few))), "token": few}), "at long, token string")

        def named(rows: DataFrame, name: str, at: Column) -> DataFrame:
            return rows.withColumn("at", at).join(F.broadcast(names.withColumnRenamed("token", name)), "at").drop("at")

        return named(named(counts, "x", F.shiftright("pair", 32)), "y", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).select("x", "y", "n")
    near = F.flatten(F.transform("_t", lambda x, i: F.transform(
        F.slice("_t", i + 2, window), lambda y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))))
    counts = lists.select(F.inline(near)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    if known is None:
        return counts
    return (counts.join(known.withColumnRenamed("token", "x"), "x", "left_semi")
            .join(known.withColumnRenamed("token", "y"), "y", "left_semi").select("x", "y", "n"))


def information(texts: DataFrame, text_col: str = "text", window: int = WINDOW, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(tokens(token, n), cells(i, j, v)): tokens with ``least`` occurrences, and the non-zero cells of the symmetric
    matrix max(0, log(n_ij N / (n_i n_j))), where the sums run over these tokens."""
    tokens = stage(texts.select(F.explode(tokenize(F.col(text_col))).alias("token")).groupBy("token")
                   .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    known = tokens.select("token")
    pairs = pair_counts(texts, text_col, window, known)
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j"), (2 * F.col("n")).alias("n")))).otherwise(
        F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j"), "n"), F.struct(F.col("y").alias("i"), F.col("x").alias("j"), "n")))
    counts = stage(pairs.select(F.inline(both)))
    sums = stage(counts.groupBy("i").agg(F.sum("n").alias("s")))
    total = float(sums.agg(F.sum("s")).first()[0] or 0)
    value = F.log(F.col("n") * F.lit(total) / (F.col("si") * F.col("sj").cast("double")))
    cells = (counts.join(sums.withColumnRenamed("s", "si"), "i")
             .join(sums.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
             .select("i", "j", value.alias("v")).filter("v > 0"))
    # cells of a row of the matrix lie together, so that the sums of a product are whole before they are shuffled
    cells = stage(cells.repartition("i").sortWithinPartitions("i"))
    forget(counts)
    return tokens, cells


def _columns(width: int) -> list[str]:
    return [f"c{k}" for k in range(width)]


def _parts(rows: int, width: int) -> int:
    """Parts of a block that fit a broadcast each."""
    return max(1, -(-rows * (8 * width + 64) // BROADCAST_BYTES))


def _fits(rows: int, width: int) -> bool:
    return _parts(rows, width) == 1


def _times(cells: DataFrame, block: DataFrame, width: int, parts: int) -> DataFrame:
    """Product of the matrix and a block: (token, c0, c1, ...). Sums are partial before the shuffle.

    The block is broadcast in ``parts``, each to the cells of its tokens: cells are never shuffled, nor made wide before they are summed.
    """
    other = block.withColumnRenamed("token", "j")
    part = F.pmod(F.xxhash64("j"), F.lit(parts))
    met = [cells.join(F.broadcast(other), "j")] if parts == 1 else [
        cells.filter(part == k).join(F.broadcast(other.filter(part == k)), "j") for k in range(parts)]
    sums = [F.sum(F.col("v") * F.col(c)).alias(c) for c in _columns(width)]
    # each part is summed on its own, so that one row a token and part is shuffled
    return functools.reduce(DataFrame.unionByName, met).groupBy(F.col("i").alias("token")).agg(*sums)


def _gram(a: DataFrame, b: DataFrame | None, width: int) -> np.ndarray:
    """a' b (or a' a), summed in each partition first; the driver gets one number a cell."""
    names = _columns(width)
    rows = a if b is None else a.join(b.select("token", *[F.col(c).alias(f"o{c}") for c in names]), "token")
    rows = rows.drop("token")

    def partial(batches):
        out = np.zeros((width, width))
        for batch in batches:
            m = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)], axis=1)
            out += m[:, :width].T @ m[:, -width:]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(out.ravel())], ["at", "v"])

    cells = rows.mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for row in cells:
        out[row.at] = row.v
    return out.reshape(width, width)


def _turned(block: DataFrame, matrix: np.ndarray, names: list[str]) -> DataFrame:
    """Each row of the block times a small matrix."""
    def run(batches):
        for batch in batches:
            m = np.stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)], axis=1) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(m[:, k])) for k in range(m.shape[1])]],
                                             ["token", *names])

    return block.mapInArrow(run, "token string, " + ", ".join(f"{n} double" for n in names))


def _orthonormal(block: DataFrame, width: int) -> DataFrame:
    """The same space with orthonormal columns; a direction that has vanished becomes zero."""
    values, vectors = np.linalg.eigh(_gram(block, None, width))
    scale = np.where(values > max(values.max(), 1e-300) * 1e-12, values, np.inf) ** -0.5
    return stage(_turned(block, vectors * scale, _columns(width)))


def leading_space(cells: DataFrame, tokens: DataFrame, dimension: int, extra: int = EXTRA, steps: int = STEPS) -> tuple[DataFrame, np.ndarray]:
    """((token, c0, ...), eigenvalues): orthonormal eigenvectors of the largest eigenvalues of the symmetric matrix.

    The first block is made of hashes of the tokens, so every run of the same data gives the same space.
    """
    width = dimension + extra
    parts = _parts(tokens.count(), width)
    start = tokens.select("token", *[(F.xxhash64("token", F.lit(k)) / F.lit(float(1 << 63))).alias(c) for k, c in enumerate(_columns(width))])
    block = _orthonormal(start, width)
    for _ in range(steps):
        # a product is made once and read twice; only the newest block stays
        image = stage(_times(cells, block, width, parts))
        older, block = block, _orthonormal(image, width)
        forget(image)
        forget(older)
    image = stage(_times(cells, block, width, parts))
    small = _gram(block, image, width)
    forget(image)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:dimension]
    return _turned(block, vectors[:, best], _columns(dimension)), values[best]


def train(texts: DataFrame, text_col: str = "text", dimension: int = fv.EMBED_DIMENSION, window: int = WINDOW,
          least: int = LEAST, extra: int = EXTRA, steps: int = STEPS) -> TokenVectors:
    """Token vectors of a corpus: eigenvectors scaled by the roots of their eigenvalues (negative ones count as 0).

    Null texts are left out; repeated texts count again. Tokens with fewer than ``least`` occurrences have no vector.
    """
    tokens, cells = information(texts, text_col, window, least)
    space, values = leading_space(cells, tokens, dimension, extra, steps)
    roots = np.sqrt(np.maximum(values, 0)).tolist()
    vec = F.array(*[F.col(c) * r for c, r in zip(_columns(dimension), roots)]).alias("vec")
    total = float(tokens.agg(F.sum("n")).first()[0] or 1)
    weight = F.lit(RARE_WEIGHT) / (F.lit(RARE_WEIGHT) + F.col("n") / F.lit(total))
    return TokenVectors(stage(space.select("token", vec).join(tokens, "token").select("token", "n", weight.alias("weight"), "vec")), dimension)


def _with_vectors(words: DataFrame, model: TokenVectors) -> DataFrame:
    """``words`` (with a column token) and their vectors. Where these are too many to broadcast, the most frequent tokens
    still are: they are those that many words would meet at."""
    rows = model.tokens.count()
    if _fits(rows, model.width):
        return words.join(F.broadcast(model.tokens), "token")
    most = BROADCAST_BYTES // (8 * model.width + 64)
    # tokens more frequent than total / most are fewer than most
    least = (model.tokens.agg(F.sum("n")).first()[0] or 0) // most + 1
    hot = F.broadcast(model.tokens.filter(F.col("n") > least))
    rare = words.join(F.broadcast(hot.select("token")), "token", "left_anti")
    return words.join(hot, "token").unionByName(rare.join(model.tokens.filter(F.col("n") <= least), "token"))


def embed_trained(df: DataFrame, model: TokenVectors, id_col: str = "chunk_id", text_col: str = "text", vec_col: str = "vec") -> DataFrame:
    """``df`` with ``vec_col``: the mean of the vectors of a text's tokens, frequent ones weighing less, of unit length.

    A text without a known token, or without a text, gets the zero vector. ``id_col`` names a row; rows
    with one id get the vector of all their texts together.
    """
    names = _columns(model.width)
    words = (df.select(F.col(id_col).alias("_id"), F.explode(tokenize(F.col(text_col))).alias("token"))
             .groupBy("_id", "token").agg(F.count(F.lit(1)).alias("_tf")))
    found = _with_vectors(words, model)
    sums = found.groupBy("_id").agg(*[F.sum(F.col("_tf") * F.col("weight") * F.col("vec")[k]).alias(c) for k, c in enumerate(names)])
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    unit: Column = F.array(*[(F.col(c) / F.greatest(F.col("_length"), F.lit(1e-9))).cast("float") for c in names])
    vectors = sums.withColumn("_length", length).select(F.col("_id").alias(id_col), unit.alias(vec_col))
    zero = F.array_repeat(F.lit(0.0).cast("float"), model.width)
    return df.join(vectors, id_col, "left").withColumn(vec_col, F.coalesce(vec_col, zero))
