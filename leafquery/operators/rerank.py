"""Rerank fused candidates by overlap and metadata agreement."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import small_side
from ..functions.text import all_matches, contains_either, text_or_null, tokenize
from .fuse import text_signature

QUESTION_FIELDS = ("department", "program", "section", "entity", "year_level")
#: questions whose tokens may be broadcast to their hits
BROADCAST_QUESTIONS = 100_000


def special_terms(text: Column) -> Column:
    return F.concat(all_matches(text, fv.SPECIAL_TERM_PATTERN), all_matches(text, fv.CODE_TERM_PATTERN))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets, that is arrays without repeated values: the union's size needs no union."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def with_overlap(hits: DataFrame, asked: DataFrame, chunks: DataFrame, broadcast_questions: int = BROADCAST_QUESTIONS) -> DataFrame:
    """Chunks joined to ``hits`` (query_id, chunk_id, ...) with ``overlap`` and ``signature``.

    A chunk that many questions find is cut into tokens once.
    """
    q = small_side(asked.select("query_id", token_set(F.col("text")).alias("_q_tokens")), broadcast_questions)
    c = chunks.withColumn("_tokens", token_set(F.col("text"))).withColumn("signature", text_signature(F.col("text")))
    return c.join(hits, "chunk_id").join(q, "query_id").withColumn(
        "overlap", jaccard(F.col("_q_tokens"), F.col("_tokens"))).drop("_q_tokens", "_tokens")


def _inside(needle: Column, haystack: Column) -> Column:
    return F.coalesce((needle != "") & F.contains(haystack, F.lower(needle)), F.lit(False))


def rerank_score(candidates: DataFrame, understood: DataFrame) -> DataFrame:
    """Candidates with ``rerank_score``; terms are added in one fixed order of double additions.

    A column ``overlap`` (``jaccard`` of the tokens of question and text) is taken as it is.
    """
    asked = understood.select("query_id", token_set(F.col("text")).alias("_q_tokens"),
                              F.transform(special_terms(F.col("text")), F.lower).alias("_q_terms"),
                              *[F.col(c).alias(f"_q_{c}") for c in QUESTION_FIELDS])
    rows = candidates.join(asked, "query_id")
    low = F.lower("text")
    heading = F.lower(F.coalesce(text_or_null(F.col("heading_path")), text_or_null(F.col("heading")), F.lit(""))) \
        if "heading" in candidates.columns else F.lower(F.coalesce("heading_path", F.lit("")))
    year = functools.reduce(lambda a, b: a | b, [
        (F.col("_q_year_level") == y) & functools.reduce(lambda a, b: a | b, [F.contains(heading, F.lit(s)) for s in syns])
        for y, syns in fv.YEAR_SYNONYMS.items()])
    boosts = [
        ("term", F.exists("_q_terms", lambda t: F.contains(low, t))),
        ("department", contains_either(F.col("_q_department"), F.col("department"))),
        ("program", contains_either(F.col("_q_program"), F.col("program"))),
        ("section", contains_either(F.col("_q_section"), F.col("section"))),
        ("heading", _inside(F.col("_q_department"), heading)),
        ("heading", _inside(F.col("_q_section"), heading)),
        ("heading", _inside(F.col("_q_entity"), heading)),
        ("year", year),
        ("entity", _inside(F.col("_q_entity"), low)),
    ]
    overlap = F.col("overlap") if "overlap" in candidates.columns else jaccard(F.col("_q_tokens"), token_set(F.col("text")))
    score = F.col("rrf_score") * fv.RERANK_WEIGHTS["rrf"] + overlap * fv.RERANK_WEIGHTS["jaccard"]
    for name, cond in boosts:
        score = score + F.when(cond, fv.RERANK_BOOSTS[name]).otherwise(0.0)
    return rows.select(*candidates.columns, score.alias("rerank_score"))


def rerank(candidates: DataFrame, understood: DataFrame, k: int | Column) -> DataFrame:
    """All candidates with rerank_score, rerank_rank (0-based) and ``pool_pos``.

    pool_pos is the rank of the best ``k`` and NULL for the rest, which stay as the
    candidates that expansion may still bring in. Needs no shuffle after fusion: everything is
    partitioned by question.
    """
    scored = rerank_score(candidates, understood)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "fused_rank")
    ranked = scored.withColumn("rerank_rank", F.row_number().over(w) - 1)
    return ranked.withColumn("pool_pos", F.when(F.col("rerank_rank") < k, F.col("rerank_rank")))
