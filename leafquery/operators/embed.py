"""Text -> vector. The model is a plug-in that is loaded once per Python worker."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed_values as fv

#: texts of one batch -> matrix of one row per text
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dimension: int = fv.EMBED_DIMENSION) -> Encoder:
    """Signed feature hashing of word tokens, scaled to unit length; needs no model file."""
    token = re.compile(r"\w+")

    @functools.lru_cache(maxsize=1 << 16)
    def place(word: str) -> tuple[int, float]:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return (h >> 1) % dimension, 1.0 if h & 1 else -1.0

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            for word, n in Counter(token.findall(text.lower())).items():
                at, sign = place(word)
                out[row, at] += sign * n
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embed(df: DataFrame, text_col: str = "text", vec_col: str = "vec",
          load: Callable[[], Encoder] = hashing_encoder, dimension: int = fv.EMBED_DIMENSION,
          batch: int = fv.EMBED_BATCH, on_error: str = "zero", failures: Accumulator | None = None) -> DataFrame:
    """Add ``vec_col``; a NULL text gets a zero vector.

    A batch whose encoder fails gets zero vectors too and is counted in ``failures`` (texts, by an
    accumulator of the caller); with ``on_error="fail"`` the job fails instead.
    """
    if on_error not in ("zero", "fail"):
        raise ValueError(f"unknown on_error: {on_error}")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in series:
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at:at + batch]
                try:
                    got = np.asarray(encode([t or "" for t in part]), dtype=np.float32)
                except Exception:
                    if on_error == "fail":
                        raise
                    if failures is not None:
                        failures.add(len(part))
                    got = np.zeros((len(part), dimension), dtype=np.float32)
                rows.extend(got)
            yield pd.Series(rows, index=texts.index)

    return df.withColumn(vec_col, vectors(F.col(text_col)))


def embed_distinct(df: DataFrame, text_col: str = "text", vec_col: str = "vec", **options) -> DataFrame:
    """Encode each distinct text once and join back; worth its shuffle for repeated questions."""
    texts = embed(df.select(text_col).distinct(), text_col, vec_col, **options)
    return df.join(texts, text_col, "left")
