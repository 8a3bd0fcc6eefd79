"""Rows of courses and fees: the fast search finds what the published patterns find, in time that follows the text."""

import random
import time

from pyspark.sql import functions as F

from leafquery.functions import fixed_values as fv
from leafquery.functions.text import all_matches
from leafquery.operators import sections as S

FEE_PARTS = ["Rs", "rs.", "PKR", "Rupees", " ", "  ", "\n", "5", "1,2", "," * 3, "9" * 25, "x", "fee ", "é", "😀", "a" * 99, "b" * 100, "c" * 101, "R", "."]
COURSE_PARTS = ["CS", "ABCDEF", "-", " ", "10", "2024", "3-0-3", "NC-NC-NC", "2 (1, 1)", "\n", "|", "x", "é", "😀", "t" * 49, "u" * 98, "v" * 150, "12"]


def texts(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)] + ["", None]


def test_fast_searches_find_the_matches_of_the_published_patterns(spark):
    for parts, pattern, rows, seed in ((FEE_PARTS, fv.FEE_ROW_PATTERN, S.extract_fee_rows, 1),
                                       (COURSE_PARTS, fv.COURSE_ROW_PATTERN, S.extract_course_rows, 2)):
        df = spark.createDataFrame([(t,) for t in texts(parts, 3000, seed)], "text string").repartition(4)
        plain = S._rows(F.col("text"), pattern, ".", {S.extract_fee_rows: ["fee_type", "amount"]}.get(rows, ["course_code", "course_title", "credit_hours"]),
                        () if rows is S.extract_fee_rows else ("course_title",))
        both = df.select("text", F.to_json(plain).alias("plain"), F.to_json(rows(F.col("text"))).alias("fast"),
                         F.size(all_matches(F.col("text"), pattern)).alias("n")).collect()
        # the plain search needs one character of any kind; without one there is no match either
        assert [r for r in both if r.plain != r.fast and r.text and r.text.strip("\n")] == []
        assert sum(r.n for r in both if r.n and r.n > 0) > 200


def test_time_follows_the_text(spark):
    courses = "CS-101 | Topic | 3-0-3 |\n" + " ".join(f"in ABCDE 20{i % 90 + 10} there were many more words than numbers on this line" for i in range(400))
    fees = "Tuition fee Rs. 100\n" + "many words without any price at all " * 4000
    df = spark.createDataFrame([(courses, fees)] * 8, "courses string, fees string").repartition(4)
    started = time.time()
    found = df.select(F.sum(F.size(S.extract_course_rows(F.col("courses")))).alias("c"), F.sum(F.size(S.extract_fee_rows(F.col("fees")))).alias("f")).first()
    assert (found.c, found.f) == (8, 8)
    assert time.time() - started < 20
