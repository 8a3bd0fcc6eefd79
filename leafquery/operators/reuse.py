"""Answer reuse: exact and semantic cache tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import strip
from .dense import knn_search


def exact_key(text: Column, history: Column) -> Column:
    """md5 of the lowered, stripped question and its history text."""
    return F.md5(F.concat(F.lower(strip(text)), F.lit("|"), F.coalesce(history, F.lit(""))))


def exact_lookup(queries: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Questions with ``answer`` (NULL on a miss) and ``hit``; keys of the cache are unique."""
    found = cache.select(key, "answer")
    return queries.join(found, key, "left").withColumn("hit", F.coalesce(F.col("answer") != "", F.lit(False)))


def fifo_cap(entries: DataFrame, limit: int = fv.CACHE_LIMIT, key: str = "key") -> DataFrame:
    """One row per key: place of its first insertion, answer of its last; the newest ``limit`` stay.

    Sort and limit run as a distributed top-k.
    """
    merged = entries.groupBy(key).agg(F.min("seq").alias("seq"), F.max_by("answer", "seq").alias("answer"))
    return merged.orderBy(F.col("seq").desc()).limit(limit)


def semantic_lookup(queries: DataFrame, cache: DataFrame, threshold: float = fv.SEMANTIC_THRESHOLD,
                    **limits) -> DataFrame:
    """(query_id, seq, score, answer, hit): best entry with the same history; earliest wins ties.

    queries: query_id, history, vec; cache: seq, history, vec, answer. Many questions share the
    empty history, so that group is searched in blocks and never paired row by row.
    """
    best = knn_search(queries, cache, 1, chunk_id="seq", level="history", with_raw=True, **limits)
    return (best.drop("rank").join(cache.select("seq", "answer"), "seq")
            .withColumn("hit", F.col("raw") >= threshold)  # not the rounded score
            .select("query_id", "seq", "score", "answer", "hit"))


def semantic_append(entries: DataFrame, new: DataFrame, limit: int = fv.CACHE_LIMIT) -> DataFrame:
    """Append, then keep the newest ``limit`` entries. Rows without vector or answer are not stored."""
    usable = new.filter((F.size("vec") > 0) & (F.coalesce("answer", F.lit("")) != ""))
    stored = usable.withColumn("query", F.lower(strip(F.col("query"))))
    return entries.unionByName(stored.select(*entries.columns)).orderBy(F.col("seq").desc()).limit(limit)
