"""From sections to chunks: table shielding, header cuts, prose splitting, ids."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed_values as fv
from ..functions.text import java_regex, strip, text_or_null
from .sections import cut_before

_HEADER_LINE = r"(?m)^[^\S\n]*#{1,4}(?: .*|[^\S\n]*)$"
_NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_NOT_PRINTABLE_IN_LINE = r"[\p{C}\p{Z}&&[^ \n]]"
_PARAGRAPH_JOIN = "  \n"
_FENCE = r"(?m)(?=^[^\S\n]*(?:```|~~~))"
#: stands for a # at the start of a line of fenced code; a code point that no text may contain
_CODE_MARK = "\ufdd1"
LEVELS = ("h1", "h2", "h3", "h4")


def is_table(sections: DataFrame) -> Column:
    return F.coalesce(F.col("content_type").isin(*fv.TABLE_CONTENT_TYPES), F.lit(False)) | \
        F.contains("text", F.lit("|"))


def shield_tables(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables as single chunks with index 0, the prose that may be cut)."""
    rows = sections.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    tables = rows.filter(is_table(rows)).select(
        "*", F.lit(0).alias("chunk_index"), F.length("text").alias("chunk_size"))
    return tables, rows.filter(~is_table(rows))


# --- header cuts ------------------------------------------------------------
def _clean_lines(segment: Column) -> Column:
    """Strip lines, drop non-printing characters, join paragraphs by a hard line break."""
    lines = F.split(segment, "\n", -1)

    def shown(x: Column) -> Column:
        return F.replace(strip(x), F.lit(_CODE_MARK), F.lit("#"))

    lines = F.when(F.regexp_like(segment, F.lit(_NOT_PRINTABLE_IN_LINE)), F.transform(lines, lambda x: F.regexp_replace(
        shown(x), _NOT_PRINTABLE, ""))).otherwise(F.transform(lines, shown))
    return F.regexp_replace(F.btrim(F.array_join(lines, "\n"), F.lit("\n")), r"\n{2,}", _PARAGRAPH_JOIN)


def _shield_fences(text: Column) -> Column:
    """Lines of fenced code can't be headers: their leading # is exchanged until the text is cut."""
    def inside(seg: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.regexp_replace(seg, r"(?m)^([^\S\n]*)#", "$1" + _CODE_MARK)).otherwise(seg)
    shielded = F.array_join(F.transform(F.filter(F.split(F.concat(F.lit("\n"), text), _FENCE, -1), lambda x: x != ""), inside), "")
    return F.when(text.contains("```") | text.contains("~~~"), F.substring(shielded, 2, 2_147_483_647)).otherwise(text)


def header_parts(text: Column) -> Column:
    """Array of (h1..h4, text): a header closes all deeper ones. Fenced code holds no headers.

    Neighbours under the same headers are one part, and a part that ends in a bare
    header line joins the deeper part that follows it.
    """
    segments = F.filter(F.transform(cut_before(_shield_fences(text), _HEADER_LINE), _clean_lines), lambda s: s != "")
    part = "struct<h1:string,h2:string,h3:string,h4:string,text:string>"
    # what a segment's first line says is found once, not in each use inside the fold
    first = F.transform(segments, lambda s: F.struct(s.alias("seg"), F.substring_index(s, "\n", 1).alias("line")))
    marked = F.transform(first, lambda s: F.struct(
        s["seg"].alias("seg"), F.length(F.regexp_extract(s["line"], r"^(#{1,4})(?= |$)", 1)).alias("depth"),
        strip(F.regexp_extract(s["line"], r"^#{1,4}( .*)?", 1)).alias("title")))
    start = F.struct(F.array().cast(f"array<{part}>").alias("parts"),
                     *[F.lit(None).cast("string").alias(h) for h in LEVELS])

    def step(acc: Column, marked_segment: Column) -> Column:
        seg, depth = marked_segment["seg"], marked_segment["depth"]
        title = F.when(depth > 0, marked_segment["title"])
        now = [F.when(depth == i, title).when((depth > 0) & (depth < i), F.lit(None)).otherwise(acc[h])
               for i, h in enumerate(LEVELS, 1)]
        size = F.size(acc["parts"])
        prev = F.try_element_at(acc["parts"], F.lit(-1))
        same = F.lit(True)
        for h, n in zip(LEVELS, now):
            same = same & prev[h].eqNullSafe(n)
        count_prev = sum((prev[h].isNotNull().cast("int") for h in LEVELS), F.lit(0))
        count_now = sum((n.isNotNull().cast("int") for n in now), F.lit(0))
        bare = F.regexp_like(prev["text"], F.lit(r"(?:^|\n)#[^\n]*$"))
        joins = (size > 0) & (same | ((count_prev < count_now) & bare))
        heads = [n.alias(h) for h, n in zip(LEVELS, now)]
        merged = F.concat(F.slice(acc["parts"], F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(
            F.struct(*heads, F.concat(prev["text"], F.lit(_PARAGRAPH_JOIN), seg).alias("text"))))
        appended = F.concat(acc["parts"], F.array(F.struct(*heads, seg.alias("text"))))
        return F.struct(F.when(joins, merged).otherwise(appended).alias("parts"), *heads)

    return F.aggregate(marked, start, step)["parts"]


def split_by_headers(prose: DataFrame, whole: Column | None = None) -> DataFrame:
    """One row per header part (header_seq); h1..h4 are merged in and re-joined into heading_path.

    Rows where ``whole`` holds stay one part as they are.
    """
    uncut = F.array(F.struct(*[F.lit(None).cast("string").alias(h) for h in LEVELS], F.col("text").alias("text")))
    parts = header_parts(F.col("text") if whole is None else F.when(~whole, F.col("text")))
    # a text that cleans to nothing stays one part as it is
    parts = F.when(F.size(parts) > 0, parts).otherwise(uncut)
    keep = [c for c in prose.columns if c not in ("text", "heading_path", *LEVELS)]
    rows = prose.select(*keep, F.col("heading_path").alias("_path"),
                        F.posexplode(parts).alias("header_seq", "_part"))
    heads = [text_or_null(F.col(f"_part.{h}")) for h in LEVELS]
    joined = text_or_null(F.concat_ws(" > ", *heads))
    return rows.select(*keep, F.coalesce(joined, "_path").alias("heading_path"),
                       *[c.alias(h) for h, c in zip(LEVELS, heads)], "header_seq",
                       strip(F.col("_part.text")).alias("text"))


# --- prose splitting --------------------------------------------------------
def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy runs of pieces up to ``size``; each run starts with at most ``overlap`` of the last one."""
    start, total = 0, 0
    for end, piece in enumerate(pieces):
        if total + len(piece) > size and end > start:
            yield "".join(pieces[start:end])
            while start < end and (total > overlap or total + len(piece) > size):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    yield "".join(pieces[start:])


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that each keep the separator in front of them."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *[separator + r for r in rest]] if p]


def split_prose(text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP,
                separators: list[str] = fv.CHUNK_SEPARATORS) -> list[str]:
    """Cut at the first separator that occurs, cut oversize pieces further, pack neighbours."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    finer, out, run = separators[at + 1:], [], []
    for piece in _cut(text, separators[at]):
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        if run:
            out += _pack(run, size, overlap)
            run = []
        out += split_prose(piece, size, overlap, finer)
    if run:
        out += _pack(run, size, overlap)
    return [c for c in (p.strip() for p in out) if c]


def split_text(parts: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, whole: Column | None = None) -> DataFrame:
    """Prose rows -> chunk rows with chunk_index and chunk_size. Only oversize texts visit Python, and none where ``whole`` holds."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_long(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_prose(t, size, overlap))

    text = F.col("text")
    too_long = F.length(text) > size
    long_text = F.when(too_long if whole is None else too_long & ~whole, text)
    pieces = F.coalesce(split_long(long_text), F.filter(F.array(strip(text)), lambda t: t != ""))
    keep = [c for c in parts.columns if c not in ("text", "chunk_index", "chunk_size")]
    return (parts.select(*keep, F.posexplode(pieces).alias("chunk_index", "text"))
            .withColumn("chunk_size", F.length("text")))


def split_fixed(texts: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Plain windows of ``size`` characters every ``size - overlap``, without Python."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    last = F.greatest(F.length("text") - F.lit(overlap) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / F.lit(step)).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(F.col("text"), i * step + 1, F.lit(size)))
    keep = [c for c in texts.columns if c not in ("text", "chunk_index", "chunk_size")]
    return (texts.filter(F.length("text") > 0)
            .select(*keep, F.posexplode(pieces).alias("chunk_index", "text"))
            .withColumn("chunk_size", F.length("text")))


def chunk_sections(sections: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Tables whole, everything else by headers and then by size: one pass over the sections for both."""
    rows = sections.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    rows = rows.withColumn("_whole", is_table(rows))
    # a pipe cannot appear inside a part: any text with one is whole
    cut = split_text(split_by_headers(rows, F.col("_whole")), size, overlap, F.col("_whole"))
    added = [c for c in ("chunk_index", "chunk_size", *LEVELS, "header_seq") if c not in sections.columns]
    return cut.select(*sections.columns, *added)


# --- derived columns --------------------------------------------------------
def embedding_text() -> Column:
    """Breadcrumb lines in front of the text; missing or empty ones are left out."""
    def line(label: str, name: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(f"{label}: "), F.col(name)))

    return F.concat_ws("\n", line("Faculty", "faculty"), line("Department", "department"),
                       line("Program", "program"), line("Path", "heading_path"), text_or_null(F.col("text")))


def chunk_id() -> Column:
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    return F.sha2(F.concat_ws("|", shown("academic_level"), shown("year"), shown("page"), shown("chunk_index"),
                              F.substring("text", 1, 200)), 256)


#: What places a chunk in its document.
CHUNK_PLACE = ("page_seq", "block_seq", "sec_seq", "header_seq", "chunk_index")


def chunk_key() -> Column:
    """Id of a chunk by its document and place in it, and its whole text: different chunks never share one."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    return F.sha2(F.concat_ws("|", *[shown(n) for n in ("doc_id", "academic_level", "year", *CHUNK_PLACE)],
                              F.coalesce("text", F.lit(""))), 256)


def ingest_report(pages: DataFrame, sections: DataFrame, chunks: DataFrame,
                  level: str = "academic_level") -> DataFrame:
    """Counts of pages, documents (sections) and chunks per level in one aggregation."""
    kinds = {"pages": pages, "documents": sections, "chunks": chunks}
    rows = None
    for name, df in kinds.items():
        one = df.groupBy(level).agg(F.count(F.lit(1)).alias("n")).select(level, F.lit(name).alias("kind"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(level).agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
