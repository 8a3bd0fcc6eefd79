"""Page sources: reading, routing listed pages aside, and markdown assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fv
from ..functions.text import strip
from ..operators.ranking import top_k

PAGE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("academic_level", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
])


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages of text with a page number. The order is the page_no column, not the row order."""
    if fmt not in ("parquet", "json", "orc", "csv"):
        raise ValueError(f"unsupported page format: {fmt}")
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)


def parse_excluded_pages(spec: Column, level: Column) -> Column:
    """Comma list -> array<int>. Blanks dropped, non-integers fail, only undergraduate has any."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    return F.when(level == fv.UNDERGRADUATE, F.transform(parts, lambda p: p.cast("int"))).otherwise(
        F.array().cast("array<int>"))


def split_pages(pages: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main, seat). ``excluded`` has one row per academic_level with an ``excluded_pages`` array.

    Main pages are renumbered without gaps. Pages of a document are numbered 1..n,
    so the new number is the old one minus the listed pages before it: no window, no
    per-document shuffle.
    """
    # at most one row for each of the two levels, so it is small by construction
    listed = (excluded.filter(F.col("academic_level").isin(fv.UNDERGRADUATE, fv.POSTGRADUATE))
              .dropDuplicates(["academic_level"])
              .select("academic_level", F.array_distinct("excluded_pages").alias("_x")))
    tagged = (pages.join(F.broadcast(listed), "academic_level", "left")
              .withColumn("_x", F.coalesce("_x", F.array().cast("array<int>")))
              .withColumn("_seat", F.array_contains("_x", F.col("page_no"))))
    before = F.size(F.filter("_x", lambda p: (p >= 1) & (p < F.col("page_no"))))
    main = (tagged.filter(~F.col("_seat"))
            .withColumn("page_no", F.col("page_no") - before)
            .select(*pages.columns))
    seat = tagged.filter("_seat").select(*pages.columns)
    return main, seat


def scan_density(pages: DataFrame, sample: int = fv.SCAN_SAMPLE_PAGES,
                 threshold: float = fv.SCAN_THRESHOLD_CHARS) -> DataFrame:
    """(doc_id, sampled_pages, avg_chars, is_scanned) over the first and last pages of a document."""
    sizes = pages.select("doc_id", "page_no", F.length(strip(F.coalesce("text", F.lit("")))).alias("_len"))
    # each partition passes on at most ``sample`` rows per document and end
    picked = (top_k(sizes, ["doc_id"], [F.col("page_no").asc()], sample)
              .unionByName(top_k(sizes, ["doc_id"], [F.col("page_no").desc()], sample))
              .dropDuplicates(["doc_id", "page_no"]))
    mean = F.avg("_len")
    return picked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sampled_pages"), mean.alias("avg_chars"),
        (mean < threshold).alias("is_scanned"))


def page_block(page_no: Column, text: Column) -> Column:
    return F.concat(F.lit("## Page "), page_no.cast("string"), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def assemble_markdown(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "academic_level", "year"),
                      pages_per_part: int = 1000) -> DataFrame:
    """Page texts joined in page order under ``## Page N`` marks; pages without a result are dropped.

    A document of up to ``pages_per_part`` pages is one row. Longer ones continue in
    further parts (part_no), so no row and no group grows without bound; parts
    start at a page mark, hence cutting each part equals cutting the whole.
    """
    part = F.floor((F.col("page_no") - 1) / F.lit(pages_per_part)).cast("int")
    return (pages.filter(F.col("text").isNotNull())
            .groupBy(*keys, part.alias("part_no"))
            .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
            .select(*keys, "part_no", F.array_join(
                F.transform("_p", lambda p: page_block(p["page_no"], p["text"])), "\n\n").alias("text")))
