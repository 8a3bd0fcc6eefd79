"""Life of a question table: reuse, intent, level, retrieval, prompt messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage
from ..functions.text import expand_abbreviations
from ..operators.embed import embed
from ..operators.history import assemble_messages, history_digest, rewrite_input
from ..operators.reuse import exact_key, exact_lookup, semantic_lookup
from ..operators.understand import (classify_intent, clean_rewrite, level_from_history, needs_rewrite, prototype_score, route_seat,
                                    seat_levels)
from .ingest import Corpus
from .retrieve import retrieve


def route(queries: DataFrame, turns: DataFrame, prototypes: DataFrame, vocabulary: DataFrame,
          status: DataFrame) -> DataFrame:
    """Questions with intent, seat_route, needs_rewrite and their own is_pg / is_ug.

    queries: query_id, conv_id, turn, text, vec, use_pg.
    """
    scored = queries.join(prototype_score(queries, prototypes), "query_id", "left")
    intent = classify_intent(scored, vocabulary)
    seats = route_seat(intent.join(seat_levels(queries, turns), "query_id"), status).drop("is_pg", "is_ug")
    level = level_from_history(queries, turns)
    return seats.join(level, "query_id").withColumn("needs_rewrite", needs_rewrite(F.col("text")) & (F.col("turn") > 0))


def reuse(queries: DataFrame, turns: DataFrame, exact_cache: DataFrame, semantic_cache: DataFrame) -> DataFrame:
    """(query_id, key, history, answer, reused): exact hit first, then semantic, else NULL."""
    keyed = queries.join(history_digest(queries, turns), "query_id").withColumn(
        "key", exact_key(F.col("text"), F.col("history")))
    looked = exact_lookup(keyed, exact_cache)
    near = semantic_lookup(keyed.select("query_id", "history", "vec"), semantic_cache)
    near = near.filter("hit").select("query_id", F.col("answer").alias("_near"))
    return looked.join(near, "query_id", "left").select(
        "query_id", "key", "history", F.coalesce(F.when(F.col("hit"), F.col("answer")), F.col("_near")).alias("answer"),
        F.when(F.col("hit"), "exact").when(F.col("_near").isNotNull(), "semantic").alias("reused"))


def rewritten_questions(queries: DataFrame, turns: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None,
                        abbreviations: dict[str, str] | None = None) -> DataFrame:
    """(query_id, search_text): what is searched for each question.

    ``rewrite`` is the caller's rewriter: it gets (query_id, text, transcript) of the questions that need it and
    returns (query_id, rewritten), with fewer rows where it has nothing to say. Its answers are cleaned;
    abbreviations are then written out in every question.
    """
    text = F.col("text")
    out = queries.select("query_id", "text")
    if rewrite is not None:
        needed = queries.filter(needs_rewrite(text) & (F.col("turn") > 0))
        asked = rewrite_input(needed, turns).join(needed.select("query_id", "text"), "query_id")
        new = rewrite(asked.select("query_id", "text", "transcript")).select("query_id", "rewritten")
        out = out.join(new, "query_id", "left").select("query_id", F.when(
            F.col("rewritten").isNotNull(), clean_rewrite(F.col("rewritten"), text)).otherwise(text).alias("text"))
    return out.select("query_id", expand_abbreviations(F.col("text"), abbreviations or {}).alias("search_text"))


def answer_inputs(queries: DataFrame, turns: DataFrame, corpus: Corpus, prototypes: DataFrame, status: DataFrame,
                  exact_cache: DataFrame, semantic_cache: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None,
                  abbreviations: dict[str, str] | None = None, **embed_options) -> DataFrame:
    """One row per question: a reused answer, a seat label, or the messages to generate from.

    Retrieval searches the rewritten text, embedded anew where it differs; the prompt shows the question as asked.
    """
    # both are read by several branches below, and each holds a vector search
    found = stage(reuse(queries, turns, exact_cache, semantic_cache))
    routed = stage(route(queries, turns, prototypes, corpus.vocabulary, status))
    misses = routed.join(found.filter(F.col("answer").isNotNull()).select("query_id"), "query_id", "left_anti") \
        .filter(F.col("seat_route").isNull())
    rag = misses.filter(F.col("intent") == "RAG")
    if rewrite is not None or abbreviations:
        texts = stage(rag.join(rewritten_questions(rag, turns, rewrite, abbreviations), "query_id"))
        same = F.col("search_text") == F.col("text")
        again = embed(texts.filter(~same).drop("vec"), "search_text", **embed_options)
        rag = texts.filter(same).unionByName(again).withColumn("text", F.col("search_text"))
    contexts = retrieve(rag.select("query_id", "text", "vec", "is_pg", "is_ug", "use_pg"), corpus)
    messages = assemble_messages(misses.join(contexts, "query_id", "left"), turns)
    return (routed.select("query_id", "intent", "seat_route", "needs_rewrite").join(found, "query_id")
            .join(messages, "query_id", "left"))
