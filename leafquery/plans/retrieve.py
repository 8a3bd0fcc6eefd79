"""The composed retrieval plan: a table of questions in, one context per question out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import small_side, stage
from ..operators.bm25 import GRID_HITS, bm25_search
from ..operators.context import pack_context
from ..operators.dense import knn_search
from ..operators.fuse import fuse_legs, route_levels
from ..operators.pool import dedup_pool, expand_page, expand_section, expand_table, order_pool
from ..operators.rerank import rerank, with_overlap
from ..operators.understand import choose_strategy, understand
from .ingest import Corpus

FILTERS = ("f_department", "f_section", "f_faculty", "f_course_code")
#: hits that may be broadcast to the chunk table
BROADCAST_HITS = 1_000_000
MAX_SEARCH_K = max(max(s[1], s[2]) for s in fv.STRATEGIES)


def prepared(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Questions with metadata, strategy and the filters the strategy lets through."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    # few bytes but much work per question: a fixed count of partitions is not merged away
    q = choose_strategy(understand(queries.repartition(cores), corpus.aliases))
    return q.select(*[F.when(F.col("use_filter"), F.col(c)).alias(c) if c in FILTERS else F.col(c) for c in q.columns])


def search_both(q: DataFrame, corpus: Corpus, dense: bool = True, sparse: bool = True) -> DataFrame:
    """(query_id, leg, chunk_id, rank, score) of both searches."""
    routes = route_levels(q)
    legs = []
    if dense:
        asked = routes.filter(F.col("leg") == "dense").join(q.select("query_id", "vec", *FILTERS), "query_id")
        legs.append(knn_search(asked, corpus.chunks, "k", MAX_SEARCH_K, level="academic_level")
                    .select("query_id", F.lit("dense").alias("leg"), "chunk_id", "rank", "score"))
    if sparse:
        asked = routes.filter(F.col("leg") == "sparse").join(q.select("query_id", "text", *FILTERS), "query_id")
        legs.append(bm25_search(asked, corpus.index, "k", MAX_SEARCH_K, per_level=False, grid_hits=GRID_HITS)
                    .select("query_id", F.lit("sparse").alias("leg"), "chunk_id", "rank", "score"))
    return legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])


def retrieve_pool(q: DataFrame, corpus: Corpus, dense: bool = True, sparse: bool = True) -> DataFrame:
    """Fused, reranked, expanded, deduplicated and ordered chunks per prepared question."""
    # a few hits per question: written, their size is known, and chunks are read once without a shuffle of texts
    hits = small_side(stage(search_both(q, corpus, dense, sparse)), BROADCAST_HITS)
    # texts are shuffled once: fusion, rerank and the pool are all sums and windows of one question
    fused = fuse_legs(with_overlap(hits, q, corpus.chunks.drop("vec")).repartition("query_id"))
    plan = q.select("query_id", "rerank_k", F.col("expand_section").alias("_es"), F.col("expand_page").alias("_ep"),
                    F.col("expand_table").alias("_et"), (~F.col("is_pg") & ~F.col("is_ug")).alias("_unclear"))
    fused = fused.join(plan, "query_id")
    k = F.when(F.col("_unclear"), F.greatest(F.col("rerank_k"), F.lit(fv.AMBIGUOUS_RERANK_K))).otherwise(F.col("rerank_k"))
    pool = rerank(fused, q, k)
    for step, flag in ((expand_section, "_es"), (expand_page, "_ep"), (expand_table, "_et")):
        pool = step(pool, F.col(flag))
    return order_pool(dedup_pool(pool))


def retrieve(queries: DataFrame, corpus: Corpus, dense: bool = True, sparse: bool = True) -> DataFrame:
    """(query_id, context); without any hit the context is empty.

    queries: query_id, text, vec, is_pg, is_ug, use_pg. With one leg switched off (an
    index that is not there) the other one alone decides.
    """
    q = stage(prepared(queries, corpus))  # read by both searches, fusion and rerank
    packed = pack_context(retrieve_pool(q, corpus, dense, sparse))
    return queries.select("query_id").join(packed, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit("")))
