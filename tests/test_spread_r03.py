"""Ingestion reads its sections once, and replayed streams are spread over all cores."""

import re

import pytest
from pyspark.sql import functions as F

from leafquery.functions import fixed_values as fv
from leafquery.functions.text import _first_letters, all_matches, java_regex, matches_any
from leafquery.operators import understand as U
from leafquery.plans import ingest as P
from verification import stream_queries as SQ


def test_sections_are_cut_in_one_pass(spark):
    pages = spark.createDataFrame([(1, "undergraduate", 2026, 1, "# A\nplain\n## B\n| x | y |\n# C\n" + "words and more. " * 200)],
                                  "doc_id long, academic_level string, year int, page_no int, text string")
    chunks = P.chunks_of_pages(pages)
    assert "Union" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    rows = chunks.orderBy("page", "heading_path", "chunk_index").collect()
    tables = [r for r in rows if "|" in r.text]
    assert len(tables) == 1 and tables[0].chunk_index == 0 and tables[0].h1 is None and tables[0].chunk_size == len(tables[0].text)
    assert sum(r.h1 is not None for r in rows) >= 2


def test_replayed_rows_are_dealt_to_all_cores(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit("question "), "id").alias("text"))
    SQ.replay(spark, df, str(tmp_path / "in"))
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 2 * cores


@pytest.mark.parametrize("pattern", [fv.PROGRAM_PATTERN, fv.DESIGNATION_PATTERN, fv.COURSE_PATTERN, fv.QUESTION_COURSE_PATTERN])
def test_a_look_at_the_first_letter_changes_no_match(spark, pattern):
    assert _first_letters(pattern) != pattern
    texts = ["BS in x", "xBS in y", "éMS z\nms z", "Ph.D of it, PhD  ", "co-chairperson Dean", "CS-101 and cs 2024x EE\n205", "ABS CS 12 _BE x", "", "9BE y BE y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = java_regex("(?:)" + pattern) if not pattern.startswith("(?i)") else java_regex("(?i)(?:)" + pattern[4:])
    for r in df.select(all_matches(F.col("text"), pattern).alias("a"), F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("b")).collect():
        assert r.a == r.b


def test_levels_and_semesters_by_shared_boundaries(spark):
    texts = ["masters of", "xmasters", "m.s. and", "m.s.", "ph.d x", "mem", "remember", "bs", "abs bs.", "b.e.s", "postgraduates", "hsc", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for patterns in (fv.PG_PATTERNS, fv.UG_PATTERNS, fv.PG_PATTERNS_OPEN, fv.UG_PATTERNS_OPEN):
        one_by_one = F.lit(False)
        for p in patterns:
            one_by_one = one_by_one | F.regexp_like("text", F.lit(java_regex(p)))
        for r in df.select("text", matches_any(F.col("text"), patterns).alias("a"), one_by_one.alias("b")).collect():
            assert r.a == r.b, r.text
    seen = df.sparkSession.createDataFrame([("SEMESTER 3",), ("2nd semester",), ("third Semester",), ("semester two x",), ("no",)], "text string")
    assert [r[0] for r in seen.select(U.detect_semester(F.col("text"))).collect()] == [3, 2, 3, 2, None]
    assert re.search("contains", seen.select(U.detect_semester(F.col("text")))._jdf.queryExecution().analyzed().toString().lower())
