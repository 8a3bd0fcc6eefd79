"""Expansion, deduplication and order of the candidate pool of each question.

A pool row has query_id, fused_rank, metadata and pool_pos: its place in the pool, NULL
for a candidate outside. Every window starts with query_id, so one shuffle by question
serves all steps, and a group never exceeds the fused candidates of one question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import small_side
from ..functions.text import text_or_null


def _expand(pool: DataFrame, lead: Column, eligible: Column, enabled: Column | bool) -> DataFrame:
    """Append candidates for which ``lead`` (their place in line) is set and whose text is new."""
    inside = F.col("pool_pos").isNotNull()
    same_text = Window.partitionBy("query_id", "text")
    on = F.lit(enabled) if isinstance(enabled, bool) else F.coalesce(enabled, F.lit(False))
    marked = pool.withColumn("_lead", lead).withColumn("_seen", F.max(inside).over(same_text))
    marked = marked.withColumn("_new", on & ~inside & eligible & ~F.col("_seen") & F.col("_lead").isNotNull()
                               & (F.coalesce("text", F.lit("")) != ""))
    first = Window.partitionBy("query_id", "text", "_new").orderBy("_lead", "fused_rank")
    marked = marked.withColumn("_new", F.col("_new") & (F.row_number().over(first) == 1))
    size = F.count("pool_pos").over(Window.partitionBy("query_id"))
    line = F.row_number().over(Window.partitionBy("query_id", "_new").orderBy("_lead", "fused_rank"))
    return marked.withColumn("pool_pos", F.when(F.col("_new"), (size + line - 1).cast("int"))
                             .otherwise(F.col("pool_pos"))).select(*pool.columns)


def expand_section(pool: DataFrame, enabled: Column | bool = True) -> DataFrame:
    """Bring in candidates of the same (department, section) as a pool row, NULL matching NULL."""
    lead = F.min("pool_pos").over(Window.partitionBy("query_id", "department", "section"))
    named = (F.coalesce("department", F.lit("")) != "") | (F.coalesce("section", F.lit("")) != "")
    return _expand(pool, lead, named, enabled)


def expand_page(pool: DataFrame, enabled: Column | bool = True) -> DataFrame:
    """Bring in candidates of a page that the pool has."""
    hit = F.max(F.col("pool_pos").isNotNull()).over(Window.partitionBy("query_id", "page"))
    return _expand(pool, F.when(hit, F.lit(0)), F.coalesce("page", F.lit(0)) != 0, enabled)


def expand_table(pool: DataFrame, enabled: Column | bool = True) -> DataFrame:
    """Bring in candidates under a heading path that the pool has."""
    hit = F.max(F.col("pool_pos").isNotNull()).over(Window.partitionBy("query_id", "heading_path"))
    return _expand(pool, F.when(hit, F.lit(0)), F.coalesce("heading_path", F.lit("")) != "", enabled)


def _page(df: DataFrame) -> Column:
    return F.coalesce(F.col("source_page"), F.col("page")) if "source_page" in df.columns else F.col("page")


def _keep_last(pool: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Per key the first position with the last row."""
    cols = [c for c in pool.columns if c not in ("query_id", "pool_pos")]
    return (pool.select("query_id", "pool_pos", F.struct(*cols).alias("_row"), *[c.alias(n) for n, c in keys.items()])
            .groupBy("query_id", *keys)
            .agg(F.min("pool_pos").alias("pool_pos"), F.max_by("_row", "pool_pos").alias("_row"))
            .select("query_id", "pool_pos", *[F.col(f"_row.{c}").alias(c) for c in cols]))


def dedup_pool(pool: DataFrame) -> DataFrame:
    """Pool rows only: first by (page, chunk_index, start of text), then by the exact text."""
    inside = pool.filter(F.col("pool_pos").isNotNull())
    index = F.coalesce("chunk_index", F.lit(0))
    loose = _keep_last(inside, {"_k1": F.coalesce(_page(inside).cast("string"), F.lit("Unknown")), "_k2": index,
                                "_k3": F.substring("text", 1, fv.SIGNATURE_CHARS)})
    source = F.col("source_page") if "source_page" in pool.columns else F.lit(None).cast("int")
    return _keep_last(loose, {"_k1": source, "_k2": F.col("chunk_index"), "_k3": F.col("text")})


def order_pool(pool: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``pos``: reading order by page and chunk, earlier pool position on ties.

    strict ignores ``page`` and looks at source_page alone.
    """
    sources = [c for c in (("source_page",) if strict else ("source_page", "page")) if c in pool.columns]
    page = F.coalesce(*[F.col(c) for c in sources], F.lit(fv.LAST_PAGE))
    w = Window.partitionBy("query_id").orderBy(page, F.coalesce("chunk_index", F.lit(0)), "pool_pos")
    return pool.withColumn("pos", F.row_number().over(w) - 1)


def related_chunks(requests: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("academic_level",)) -> DataFrame:
    """All chunks of exactly the asked (department, section), NULL matching NULL.

    requests: query_id, academic_level, department, section. Chunks without both are in no group. Texts lie
    under keys of few values, so they are not shuffled: requests of checked number are broadcast to them.
    """
    def trimmed(name: str) -> Column:
        return F.trim(F.col(name))

    r = requests.select("query_id", *keys, F.coalesce(text_or_null(trimmed("department")), F.lit("")).alias("_d"),
                        F.coalesce(text_or_null(trimmed("section")), F.lit("")).alias("_s"))
    named = (F.coalesce("department", F.lit("")) != "") | (F.coalesce("section", F.lit("")) != "")
    c = chunks.filter(named).withColumn("_d", F.coalesce(text_or_null(trimmed("department")), F.lit(""))) \
        .withColumn("_s", F.coalesce(text_or_null(trimmed("section")), F.lit("")))
    return c.join(small_side(r), [*keys, "_d", "_s"]).drop("_d", "_s").select(
        "query_id", *keys, *[x for x in chunks.columns if x not in keys])
