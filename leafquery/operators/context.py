"""Pack ordered chunks of a question into one bounded context string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.text import strip, text_or_null


def _page_label(columns: list[str], names: tuple[str, ...]) -> Column:
    have = [F.nullif(F.col(c), F.lit(0)).cast("string") for c in names if c in columns]
    return F.coalesce(*have, F.lit("Unknown"))


def _source(columns: list[str], pages: tuple[str, ...]) -> Column:
    label = F.when(F.col("academic_level") == fv.UNDERGRADUATE, fv.SOURCE_LABELS["undergraduate"]) \
        .otherwise(fv.SOURCE_LABELS["other"])
    return F.concat(F.lit("[Source: "), label, F.lit(", Page "), _page_label(columns, pages), F.lit("]"))


def _first_per_text(pool: DataFrame, order: str, section: Column) -> DataFrame:
    rows = pool.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    w = Window.partitionBy("query_id", "text").orderBy(order)
    return (rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
            .withColumn("_section", section))


def _pack(blocks: DataFrame, order: list[str], size: Column, max_chars: int, separator: str) -> DataFrame:
    """Blocks in order while their running size fits; the first that does not fit ends the context."""
    w = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fitting = blocks.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= max_chars)
    packed = F.array_sort(F.collect_list(F.struct(*order, "_block")))
    return fitting.groupBy("query_id").agg(
        F.array_join(F.transform(packed, lambda b: b["_block"]), separator).alias("context"))


def pack_context(pool: DataFrame, max_chars: int = fv.CONTEXT_CHARS, per_section: int = fv.CONTEXT_PER_SECTION,
                 align_sections: bool = True) -> DataFrame:
    """(query_id, context): grouped by section in the preferred order, at most ``per_section`` each."""
    section = F.coalesce(text_or_null(F.col("section")), F.lit("general"))
    if align_sections:
        for plural, singular in fv.SECTION_SINGULAR.items():
            section = F.when(section == plural, singular).otherwise(section)
    rows = _first_per_text(pool, "pos", section)
    rank = None
    for i, name in enumerate(fv.SECTION_ORDER):
        cond = F.col("_section") == name
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
    by_section = Window.partitionBy("query_id", "_section")
    rows = (rows.withColumn("_rank", rank.otherwise(len(fv.SECTION_ORDER)))
            .withColumn("_seen", F.when(F.col("_rank") == len(fv.SECTION_ORDER), F.min("pos").over(by_section)).otherwise(0))
            .withColumn("_nth", F.row_number().over(by_section.orderBy("pos")))
            .filter(F.col("_nth") <= per_section))
    heads = [text_or_null(F.col(c)) for c in ("heading_path", "heading") if c in pool.columns]
    block = F.concat(_source(pool.columns, ("source_page", "page")), F.lit("\nSection:"), F.col("_section"), F.lit("\n"),
                     F.coalesce(*heads, F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = rows.select("query_id", "_rank", "_seen", "pos", block.alias("_block"))
    return _pack(rows, ["_rank", "_seen", "pos"], F.length("_block"), max_chars, fv.CONTEXT_SEPARATOR)


def pack_context_flat(pool: DataFrame, max_chars: int = fv.CONTEXT_CHARS, per_section: int = fv.CONTEXT_PER_SECTION,
                      order: str = "pos") -> DataFrame:
    """(query_id, context) in the given order without grouping; the budget counts raw text."""
    rows = _first_per_text(pool, order, F.coalesce(text_or_null(F.col("section")), F.lit("unknown")))
    nth = F.row_number().over(Window.partitionBy("query_id", "_section").orderBy(order))
    rows = rows.withColumn("_nth", nth).filter(F.col("_nth") <= per_section)
    block = F.concat(_source(pool.columns, ("source_page",)), F.lit("\n"), F.col("text"))
    rows = rows.select("query_id", order, F.length("text").alias("_len"), block.alias("_block"))
    return _pack(rows, [order], F.col("_len"), max_chars, fv.FLAT_CONTEXT_SEPARATOR)
