"""From page blocks to sections with carried context, labels and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import stage
from ..functions.text import (all_matches, contains_any, first_group, first_match, java_regex, matches, strip,
                              strip_markup)

#: a code point that no text may contain, used to mark cut places
CUT = "﷐"
CONTEXT = ("page", "faculty", "department", "program")
DOC_KEYS = ("doc_id", "academic_level", "year")


def cut_before(text: Column, pattern: str) -> Column:
    """Cut in front of each non-overlapping match. Element 0 is what precedes the first match."""
    marked = F.regexp_replace(text, F.lit("(" + java_regex(pattern) + ")"), F.lit(CUT + "$1"))
    return F.split(marked, CUT, -1)


def split_page_blocks(markdown: DataFrame, text_col: str = "text", pos_col: str = "page_seq") -> DataFrame:
    """One row per block in front of a ``## Page N`` line; blank blocks are dropped."""
    keep = [c for c in markdown.columns if c != text_col]
    return (markdown.select(*keep, F.posexplode(cut_before(F.col(text_col), fv.PAGE_PATTERN)).alias(pos_col, text_col))
            .filter(strip(F.col(text_col)) != ""))


def heading_sections(block: Column) -> Column:
    """Array of sections. With any heading, the text in front of the first one is lost."""
    parts = cut_before(block, fv.HEADING_PATTERN)
    parts = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def split_heading_sections(blocks: DataFrame, text_col: str = "text", pos_col: str = "sec_seq") -> DataFrame:
    keep = [c for c in blocks.columns if c != text_col]
    return blocks.select(*keep, F.posexplode(heading_sections(F.col(text_col))).alias(pos_col, text_col))


# --- context ----------------------------------------------------------------
_LINE_HEADING = r"(?m)^(#{1,6})[^\S\n]+(.+)$"


def line_headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?d)" + _LINE_HEADING), F.lit(2))


def scan_context(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Add what one scan of ``text`` sets; NULL means the value is left as it was.

    The first pattern match counts, then heading lines override and the last heading
    wins. An empty capture sets the empty string, which is not the same as NULL. Each pattern
    walks the text once; captures are taken from the short match.
    """
    text = F.col("text")
    patterns = {"page": fv.PAGE_PATTERN, "faculty": fv.FACULTY_PATTERN, "program": fv.PROGRAM_PATTERN,
                "department": fv.DEPARTMENT_PATTERN_STRICT if strict else fv.DEPARTMENT_PATTERN}
    # words of which a match has one: looked for first, since that costs less than the pattern
    needs = {"faculty": ["faculty", "school", "college"], "department": ["department", "dept"]}

    def match_of(name: str) -> Column:
        match = first_match(text, patterns[name])
        return F.when(contains_any(F.lower(text), needs[name]), match) if name in needs else match

    found = rows.select("*", line_headings(text).alias("_heads"), *[match_of(n).alias(f"_{n}") for n in patterns])

    def about_department(h: Column) -> Column:
        return contains_any(F.lower(h), ["department", "dept"])

    def last_heading(condition, prefix: str) -> Column:
        heads = F.filter("_heads", condition)
        return strip(F.replace(F.try_element_at(heads, F.lit(-1)), F.lit(prefix), F.lit("")))

    def capture(name: str) -> Column:
        match = F.col(f"_{name}")
        return F.when(match.isNotNull(), strip_markup(F.regexp_extract(match, java_regex(patterns[name]), 1)))

    return found.select(
        *rows.columns,
        F.regexp_extract("_page", java_regex(fv.PAGE_PATTERN), 1).try_cast("int").alias("page"),
        F.coalesce(last_heading(lambda h: ~about_department(h) & F.contains(F.lower(h), F.lit("faculty")), "Faculty of"),
                   capture("faculty")).alias("faculty"),
        F.coalesce(last_heading(about_department, "Department of"), capture("department")).alias("department"),
        capture("program").alias("program"))


def carry_forward(df: DataFrame, keys: list[str], segment: str, order: list[str], values: list[str]) -> DataFrame:
    """Fill each value with the last non-null one before it in ``order`` within ``keys``.

    ``segment`` is a coarse, monotone prefix of the order. Rows are only brought
    together per (keys, segment), so a key that owns a third of the table is still
    spread over many tasks; between segments only one small row per segment is passed on.
    """
    where = F.struct(*order)
    last_in_segment = df.groupBy(*keys, segment).agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), where)).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    incoming = last_in_segment.select(*keys, segment, *[
        F.last(F.col(v), ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])
    here = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.select(*[c for c in df.columns if c not in values], *[
        F.last(F.col(v), ignorenulls=True).over(here).alias(v) for v in values])
    out = filled.join(incoming, [*keys, segment], "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_in_{c}")).alias(c) if c in values else F.col(c)
                        for c in df.columns])


def carry_context(blocks: DataFrame, keys: tuple[str, ...] = DOC_KEYS, order: tuple[str, ...] = ("page_seq",),
                  pages_per_segment: int = 256, strict: bool = False, staged: bool = False) -> DataFrame:
    """Sections of every block with page, faculty, department and program carried across blocks.

    Blocks of a document in parts (``part_no``, as ``assemble_markdown`` makes them) are ordered by part first.
    Each block is scanned as a whole first (row sec_seq = -1), then each of its sections. The scan
    is read twice (values between segments, values inside them); ``staged`` writes it once.
    """
    in_parts = "part_no" in blocks.columns and "part_no" not in order
    order = ("part_no", *order) if in_parts else order
    keep = [*keys, *order]
    whole = F.array(F.struct(F.lit(-1).alias("sec_seq"), F.col("text").alias("text")))
    parts = F.transform(heading_sections(F.col("text")),
                        lambda s, i: F.struct(i.alias("sec_seq"), s.alias("text")))
    rows = blocks.select(*keep, F.explode(F.concat(whole, parts)).alias("_s")).select(
        *keep, F.col("_s.sec_seq").alias("sec_seq"), F.col("_s.text").alias("text"))
    scanned = scan_context(rows, strict)
    # the whole-block text has done its work; do not shuffle it
    scanned = scanned.withColumn("text", F.when(F.col("sec_seq") >= 0, F.col("text")))
    # a part is bounded by itself, pages are put together
    scanned = scanned.withColumn("_segment", F.col("part_no").cast("long") if in_parts else
                                 F.floor(F.col(order[0]) / F.lit(pages_per_segment)))
    if staged:
        scanned = stage(scanned)
    filled = carry_forward(scanned, list(keys), "_segment", [*order, "sec_seq"], list(CONTEXT))
    return filled.filter(F.col("sec_seq") >= 0).drop("_segment")


# --- labels -----------------------------------------------------------------
def heading_columns(text: Column) -> dict[str, Column]:
    heads = F.transform(line_headings(text), strip)
    path = F.when(F.size(heads) > 0, F.array_join(heads, " > "))
    return {
        "heading": path,
        "heading_path": path,
        "heading_leaf": F.when(F.size(heads) > 0, F.element_at(heads, -1)),
        "heading_depth": F.size(heads),
    }


def classify_section(text: Column) -> Column:
    return first_group(F.lower(text), fv.DOCUMENT_SECTIONS, default="general")


def classify_content(text: Column) -> Column:
    return (F.when(~F.contains(text, F.lit("|")), "text")
            .when(matches(text, fv.COURSE_PATTERN), "curriculum_table")
            .when(contains_any(F.lower(text), fv.FEE_TABLE_WORDS), "fee_table")
            .otherwise("table"))


def first_match_fields(text: Column) -> dict[str, Column]:
    return {
        "semester": first_match(text, fv.SEMESTER_PATTERN, 1).try_cast("int"),
        "course_code": strip(first_match(text, fv.COURSE_PATTERN)),
        "person_name": strip(first_match(text, fv.PERSON_PATTERN)),
        "designation": strip(first_match(text, fv.DESIGNATION_PATTERN)),
    }


def all_codes_and_programs(text: Column) -> dict[str, Column]:
    return {
        "course_codes": F.array_sort(F.array_distinct(all_matches(text, fv.COURSE_PATTERN))),
        "programs": F.array_sort(F.array_distinct(
            F.transform(all_matches(text, fv.PROGRAM_PATTERN, 1), strip_markup))),
    }


def _before_ends(text: Column, end: str, before: int) -> Column:
    """The matches of ``end`` in ``text`` with at most ``before`` characters of their line in front of each; the rest goes.

    What lies between two ends is cut to its last line and that to its last characters, behind a line break, so a
    row pattern that has its free text in front of ``end`` finds the rows that it finds in the whole text.
    """
    def kept(between: Column, match: Column) -> Column:
        near = F.substring(F.substring_index(between, "\n", -1), -before, before)
        return F.concat(F.when(near != between, F.concat(F.lit("\n"), near)).otherwise(between), match)

    # nothing ends what lies behind the last match: it is null and not joined
    return F.array_join(F.zip_with(F.split(text, java_regex(end), -1), all_matches(text, end), kept), "")


def _rows(text: Column, pattern: str, needs: str, fields: list[str], stripped: tuple[str, ...] = (),
          search: str | None = None, within: Column | None = None) -> Column:
    """One struct per match of a lazy row pattern.

    The patterns try up to a hundred lengths at every character, so only texts with the
    part that a match must have (``needs``, a linear scan) are searched, once; the groups
    then come from the short matches. ``search`` finds the same matches at less cost, ``within`` is a shorter text with the same ones.
    """
    found = F.when(matches(text, needs), all_matches(text if within is None else within, search or pattern)).otherwise(
        F.array().cast("array<string>"))

    def group(match: Column, i: int, name: str) -> Column:
        value = F.regexp_extract(match, java_regex(pattern), i)
        return (strip(value) if name in stripped else value).alias(name)

    return F.transform(found, lambda m: F.struct(*[group(m, i, n) for i, n in enumerate(fields, 1)]))


def extract_faculty_rows(text: Column) -> Column:
    return _rows(text, fv.FACULTY_ROW_PATTERN, fv.FACULTY_ROW_NEEDS, ["designation", "person_name"], ("person_name",))


def extract_course_rows(text: Column) -> Column:
    return _rows(text, fv.COURSE_ROW_PATTERN, fv.COURSE_ROW_NEEDS, ["course_code", "course_title", "credit_hours"],
                 ("course_title",), search=fv.COURSE_ROW_SEARCH)


def extract_fee_rows(text: Column) -> Column:
    return _rows(text, fv.FEE_ROW_PATTERN, fv.FEE_ROW_NEEDS, ["fee_type", "amount"],
                 within=_before_ends(text, fv.FEE_ROW_END, fv.FEE_ROW_BEFORE))


def fee_amount(amount: Column) -> Column:
    """``12,500`` -> 12500; a string of commas only has no value."""
    return F.nullif(F.replace(amount, F.lit(","), F.lit("")), F.lit("")).try_cast("long")


def label_sections(sections: DataFrame) -> DataFrame:
    """Every section-level column of the chunk schema, from the text alone."""
    text = F.col("text")
    cols: dict[str, Column] = {}
    cols.update(heading_columns(text))
    cols["section"] = classify_section(text)
    cols["content_type"] = classify_content(text)
    cols.update(first_match_fields(text))
    cols.update(all_codes_and_programs(text))
    for name, rows in (("faculty_entities", extract_faculty_rows(text)),
                       ("curriculum_entities", extract_course_rows(text)),
                       ("fee_entities", extract_fee_rows(text))):
        cols[name] = F.when(F.size(rows) > 0, rows)
    return sections.select("*", *[c.alias(n) for n, c in cols.items()])
