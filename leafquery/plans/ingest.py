"""Pages of documents -> labelled, chunked, embedded rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import stage
from ..operators.bm25 import Bm25Index, bm25_index, rich_text, searchable
from ..operators.chunks import chunk_id, chunk_key, chunk_sections, embedding_text
from ..operators.embed import embed
from ..operators.sections import DOC_KEYS, carry_context, label_sections, split_page_blocks
from ..operators.vocab import all_aliases, keyword_vocab
from ..sources.pages import page_block
from ..sources.tables import CHUNK_SCHEMA, export_chunks, read_chunks


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """Page rows -> blocks with an explicit order.

    Every page starts with its mark, so cutting page by page equals cutting the assembled document
    and no document has to fit into one row.
    """
    marked = pages.filter(F.col("text").isNotNull()).select(
        *DOC_KEYS, F.col("page_no").alias("page_seq"), page_block(F.col("page_no"), F.col("text")).alias("text"))
    return split_page_blocks(marked, pos_col="block_seq")


def sections_of_pages(pages: DataFrame, strict: bool = False, staged: bool = False) -> DataFrame:
    """Labelled sections; the only shuffle of texts is the one that carries context forward."""
    return label_sections(carry_context(blocks_of_pages(pages), order=("page_seq", "block_seq"), strict=strict,
                                        staged=staged))


def chunks_of_sections(sections: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP,
                       short_ids: bool = False) -> DataFrame:
    """Chunk table in the canonical schema; narrow, nothing is shuffled.

    Ids name the document and the place in it. ``short_ids`` gives the published form (level, year, page,
    index and the first 200 characters), which several documents may share.
    """
    chunks = chunk_sections(sections, size, overlap).withColumn("chunk_id", chunk_id() if short_ids else chunk_key())
    return chunks.select(*[F.col(f.name).cast(f.dataType) for f in CHUNK_SCHEMA.fields])


def chunks_of_pages(pages: DataFrame, staged: bool = True, **options) -> DataFrame:
    return chunks_of_sections(sections_of_pages(pages, staged=staged), **options)


@dataclass
class Corpus:
    """Everything a question needs: chunks with vectors, the keyword index, aliases, vocabulary."""

    chunks: DataFrame
    index: Bm25Index
    aliases: DataFrame
    vocabulary: DataFrame


def build_corpus(chunks: DataFrame, vectors: DataFrame | None = None, staged: bool = False, **embed_options) -> Corpus:
    """Corpus tables as plans over ``chunks``, of which every row with a text is kept.

    ``staged`` writes postings, aliases and vocabulary once instead of deriving them in each use.
    """
    kept = searchable(chunks)
    with_text = kept.withColumn("_embed", embedding_text())
    embedded = (kept.join(vectors.select("chunk_id", "vec"), "chunk_id", "left") if vectors is not None
                else embed(with_text, "_embed", **embed_options).drop("_embed"))
    aliases, vocabulary = all_aliases(kept), keyword_vocab(kept)
    if staged:
        aliases, vocabulary = stage(aliases), stage(vocabulary)
    return Corpus(embedded, bm25_index(kept, rich_text(), staged=staged), aliases, vocabulary)


def write_corpus(chunks: DataFrame, path: str, **embed_options) -> None:
    """Stage the chunk table once, then derive the index tables from what was written."""
    spark = chunks.sparkSession
    export_chunks(chunks, f"{path}/chunks")
    corpus = build_corpus(read_chunks(spark, f"{path}/chunks"), **embed_options)
    corpus.index.write(f"{path}/index")
    corpus.chunks.write.mode("overwrite").parquet(f"{path}/vectors")
    corpus.aliases.write.mode("overwrite").parquet(f"{path}/aliases")
    corpus.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_corpus(spark, path: str) -> Corpus:
    return Corpus(spark.read.parquet(f"{path}/vectors"), Bm25Index.read(spark, f"{path}/index"),
                  spark.read.parquet(f"{path}/aliases"), spark.read.parquet(f"{path}/vocabulary"))
