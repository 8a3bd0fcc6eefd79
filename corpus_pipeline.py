"""From raw documents to packed sequences: quality, lines, near copies, benchmark leaks, packing.

Each stage gets what the one before it kept, as a table read back from Parquet, and returns all its columns
(the last one returns the pieces of ``op8``). Rejected documents go, dropped lines leave their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafquery.functions.staging import stage
from leafquery.llm import decontaminate, jaccard, line_dedup, packing, quality
from leafquery.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    ship_package(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.scorer(model)(F.col("text")) >= 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 documents or more leave the texts; n_chars is that of the text that stays."""
    ship_package(spark)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    out = line_dedup.dedup_lines(docs)
    return out.select([new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id."""
    ship_package(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    hits = decontaminate.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), F.col("text"))
    return docs.filter(F.size(hits) == 0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a trained model, an exact join and a tokenizer: tests hold each stage against brute force

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
