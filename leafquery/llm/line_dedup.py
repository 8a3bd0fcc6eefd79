"""Line dedup: lines that many documents share leave every document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafquery.functions.staging import stage
from leafquery.llm.common import WHITE, ascii_lower, keyed


def line_hashes(lines: Column, min_chars: int) -> Column:
    """16-byte hash of each line's key, null for keys shorter than ``min_chars`` code points."""
    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(WHITE))
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(ascii_lower(key))))
    return F.transform(lines, one)


def common_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(hash) of the line keys found in at least ``min_docs`` rows of (text).

    A row's equal lines are made one before they are exploded and counts are pre-aggregated in each
    task, so a line of a third of all documents is a few partial counts when it is shuffled.
    """
    hashes = line_hashes(F.split("text", "\n", -1), min_chars)
    return (rows.select(F.explode(F.array_distinct(F.filter(hashes, lambda h: h.isNotNull()))).alias("hash"))
            .groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("hash"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, *, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): every text without the lines that ``min_docs`` documents share.

    Texts are split at ``\\n``; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z
    lower-cased. Keys shorter than ``min_chars`` code points are never dropped. A null or empty
    text is one empty line. Repeated rows count as documents of their own. A text that loses all
    its lines becomes empty; its row stays. An empty table gives an empty result. Other columns
    come back in ``row``, whatever their names.
    """
    rows = keyed(docs, id_col, text_col)
    # written out, so that the join deals both sides anew and can split a hot hash, or broadcasts by file size
    common = stage(common_lines(rows, min_docs, min_chars))
    at = rows.select("key", F.posexplode(line_hashes(F.split("text", "\n", -1), min_chars)).alias("pos", "hash"))
    drops = (at.filter(F.col("hash").isNotNull()).join(common, "hash")
             .groupBy("key").agg(F.collect_set("pos").alias("drop")))

    def kept(lines: Column, drop: Column) -> Column:
        # positions that stay, by hashing, then the lines at them: linear in the number of lines
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.struct(F.size(lines).alias("n"),
                        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text"))

    drop = F.coalesce(F.col("drop"), F.array().cast("array<int>"))
    # the lines are bound as a lambda variable: split once, not once for every line
    out = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: kept(lines, drop))[0]
    return (rows.select("row", "text", "key").join(drops, "key", "left")
            .select("row", "text", "drop",
                    F.when(F.col("drop").isNull(),
                           F.struct(F.size(F.split("text", "\n", -1)).alias("n"), F.col("text").alias("text")))
                    .otherwise(out).alias("out"))
            .select("row", F.col("out.n").cast("long").alias("n_lines"),
                    F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.col("out.text").alias("kept_text")))
