"""Vocabularies and alias dictionaries aggregated from chunk metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import SPACE, java_regex, strip


def _names(chunks: DataFrame, column: str) -> DataFrame:
    return (chunks.select(strip(F.col(column)).alias("name")).filter(F.col("name") != "").distinct())


def keyword_vocab(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(word): letters-only words longer than 3 from departments and designations, plus stored ones."""
    def cleaned(name: Column, prefixes: tuple[str, ...]) -> Column:
        out = F.lower(name)
        for p in prefixes:
            out = F.replace(out, F.lit(p), F.lit(""))
        return out

    departments = chunks.select(cleaned(F.col("department"), ("department of ", "dept of ")).alias("name"))
    designations = chunks.select(cleaned(F.col("designation"), ()).alias("name"))
    names = departments.unionByName(designations).filter(F.col("name").isNotNull()).distinct()
    found = (names.select(F.explode(F.split("name", SPACE + "+")).alias("word"))
             .select(F.regexp_replace("word", r"[^\p{L}]", "").alias("word"))
             .filter(F.length("word") > 3))
    if existing is not None:
        found = found.unionByName(existing.select("word"))
    return found.distinct()


def _aliases(names: DataFrame, kind: str, extra) -> DataFrame:
    low = F.lower("name")
    clean = strip(F.regexp_replace(low, java_regex(fv.NUMBERING_PATTERN), ""))
    squeezed = F.transform(
        F.filter(F.array(low, clean, extra(clean)), lambda a: a.isNotNull() & (F.length(a) > 2)),
        lambda a: strip(F.regexp_replace(a, SPACE + "+", " ")))
    return names.select(F.lit(kind).alias("kind"), "name", F.explode(F.array_distinct(squeezed)).alias("alias"))


def _without(text: Column, *words: str) -> Column:
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(""))
    text = strip(text)
    return F.when(F.length(text) > 2, text)


def department_aliases(chunks: DataFrame) -> DataFrame:
    """(kind, name, alias) of departments."""
    names = _names(chunks, "department").filter(F.length("name") <= fv.MAX_NAME_CHARS)
    return _aliases(names, "department", lambda c: F.when(
        F.contains(c, F.lit("department")), _without(c, "departments", "department", "of")))


def faculty_aliases(chunks: DataFrame) -> DataFrame:
    names = _names(chunks, "faculty").filter(
        (F.length("name") <= fv.MAX_NAME_CHARS) & ~F.lower("name").isin(*fv.GENERIC_FACULTY_NAMES))
    return _aliases(names, "faculty", lambda c: F.when(F.contains(c, F.lit("faculty")), _without(c, "faculty", "of")))


def program_aliases(chunks: DataFrame) -> DataFrame:
    names = _names(chunks, "program").filter(F.length("name") <= fv.MAX_NAME_CHARS)

    def no_degree(clean: Column) -> Column:
        return _without(F.regexp_replace(clean, java_regex(fv.DEGREE_PREFIX_PATTERN), ""))

    return _aliases(names, "program", no_degree)


def designation_terms(chunks: DataFrame) -> DataFrame:
    """(kind, name, alias) of designations; they extend the faculty section and the entity words."""
    return (_names(chunks, "designation").filter(F.length("name") <= fv.MAX_DESIGNATION_CHARS)
            .select(F.lower("name").alias("name")).distinct()
            .select(F.lit("designation").alias("kind"), "name", F.col("name").alias("alias")))


def all_aliases(chunks: DataFrame) -> DataFrame:
    """Every alias used for question understanding.

    A department is also found by its lowered name as it is (before spaces are squeezed).
    """
    whole = _names(chunks, "department").filter(F.length("name") <= fv.MAX_NAME_CHARS).select(
        F.lit("department").alias("kind"), "name", F.lower("name").alias("alias"))
    return (department_aliases(chunks).unionByName(whole).unionByName(faculty_aliases(chunks))
            .unionByName(program_aliases(chunks)).unionByName(designation_terms(chunks)).distinct())
