"""Level routing, merging of result lists and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import SPACE, strip
from .ranking import by_score, top_k


def route_levels(queries: DataFrame) -> DataFrame:
    """One row per (query_id, leg, academic_level, k) a question searches.

    ``queries``: query_id, is_pg, is_ug, use_pg, dense_k, sparse_k. Dense search without
    a level takes 2k before the cut to k; both levels searched and cut to k is the same list.
    """
    pg, ug, use_pg = F.col("is_pg"), F.col("is_ug"), F.col("use_pg")
    unclear = ~pg & ~ug
    both = F.array(F.lit(fv.POSTGRADUATE), F.lit(fv.UNDERGRADUATE))
    dense = (F.when(~use_pg, F.array(F.lit(fv.UNDERGRADUATE)))
             .when(pg & ~ug, F.array(F.lit(fv.POSTGRADUATE)))
             .when(ug & ~pg, F.array(F.lit(fv.UNDERGRADUATE))).otherwise(both))
    sparse = F.filter(F.array(F.when(use_pg & (pg | unclear), fv.POSTGRADUATE),
                              F.when(ug | unclear, fv.UNDERGRADUATE)), lambda x: x.isNotNull())
    legs = F.array(F.struct(F.lit("dense").alias("leg"), dense.alias("levels"), F.col("dense_k").alias("k")),
                   F.struct(F.lit("sparse").alias("leg"), sparse.alias("levels"), F.col("sparse_k").alias("k")))
    return (queries.select("query_id", F.explode(legs).alias("_l"))
            .select("query_id", "_l.leg", F.explode("_l.levels").alias("academic_level"), "_l.k"))


def merge_levels(parts: list[DataFrame], k: int) -> DataFrame:
    """Union of per-level lists, sorted again by score and cut to ``k``."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return top_k(rows.drop("rank"), ["query_id"], by_score("score", "chunk_id"), k)


def text_signature(text: Column) -> Column:
    """Fusion key part: the first 100 characters of the lowered text without white space."""
    return F.substring(F.regexp_replace(F.lower(text), SPACE + "+", ""), 1, fv.SIGNATURE_CHARS)


def page_key(columns: list[str]) -> Column:
    sources = [c for c in ("source_page", "page") if c in columns]
    return F.coalesce(*[F.col(c).cast("string") for c in sources], F.lit("Unknown"))


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = fv.RRF_LIMIT, constant: float = fv.RRF_CONSTANT) -> DataFrame:
    """``fuse_legs`` of two result lists with the same columns: query_id, rank, text, page and any others."""
    rows = dense.withColumn("leg", F.lit("dense")).unionByName(sparse.withColumn("leg", F.lit("sparse")))
    return fuse_legs(rows, k, constant)


def fuse_legs(rows: DataFrame, k: int = fv.RRF_LIMIT, constant: float = fv.RRF_CONSTANT) -> DataFrame:
    """Fused candidates with rrf_score and fused_rank (0-based), at most ``k`` per question.

    rows: query_id, leg (dense or sparse), rank (0-based), text, page and further columns (``signature``: the
    ``text_signature`` of the text, else made here). Inside a
    list the later rank of a repeated key counts while its first row stays; the dense
    row wins over the sparse one. One aggregation replaces a full outer join.
    """
    meta = [c for c in rows.columns if c not in ("query_id", "leg", "rank", "score", "signature")]
    signature = F.col("signature") if "signature" in rows.columns else text_signature(F.col("text"))
    keyed = rows.select("query_id", F.when(F.col("leg") == "dense", 0).otherwise(1).alias("_leg"),
                        F.col("rank").alias("_rank"), F.struct(*meta).alias("_row"), page_key(rows.columns).alias("_page"),
                        signature.alias("_sig"))
    where = F.struct("_leg", "_rank")

    def part(leg: int) -> Column:
        return F.coalesce(1.0 / (F.lit(constant) + F.max(F.when(F.col("_leg") == leg, F.col("_rank")))), F.lit(0.0))

    fused = (keyed.groupBy("query_id", "_page", "_sig")
             .agg((part(0) + part(1)).alias("rrf_score"), F.min_by("_row", where).alias("_row"),
                  F.min(where).alias("_first")))
    ranked = top_k(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("_first").asc()], k, rank_col="fused_rank")
    return ranked.select("query_id", "fused_rank", "rrf_score", *[
        (strip(F.col("_row.text")) if c == "text" else F.col(f"_row.{c}")).alias(c) for c in meta])
