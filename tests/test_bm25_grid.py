"""a search in cells gives the rows of the join, and no pair of question and chunk leaves a cell but its best."""
import random

import pytest
from pyspark.sql import functions as F

from leafquery.operators import bm25 as BM

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    chunks = [(f"c{i}", rng.choice(["pg", "ug"]), rng.choice(["d1", "d2", None]), rng.choice(["s1", None]),
               rng.choice([["A 1"], ["A 1", "B 2"], None]),
               " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 30)))) for i in range(300)]
    asked = [(i, level, rng.choice(["d1", None, None]), rng.choice(["s1", None, None]), rng.choice(["B 2", None, None]), 1 + i % 4,
              " ".join(rng.choices([*WORDS, "never"], k=rng.randint(1, 8)))) for i in range(120) for level in ("pg", "ug", "none")]
    c = spark.createDataFrame(chunks, "chunk_id string, academic_level string, department string, section string, course_codes array<string>, text string")
    q = spark.createDataFrame(asked, "query_id long, academic_level string, f_department string, f_section string, f_course_code string, k int, text string")
    return q, BM.bm25_index(c, staged=True)


def rows(df):
    return sorted((r.query_id, r.academic_level, r.chunk_id, r["rank"], round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("k, per_level", [(3, True), ("k", False)])
@pytest.mark.parametrize("cells", [(50, 40), (10 ** 6, 10 ** 6)])
def test_cells_give_the_rows_of_the_join(tables, monkeypatch, k, per_level, cells):
    q, index = tables
    monkeypatch.setattr(BM, "LEAST_POSTINGS", 40)
    grid = BM.bm25_grid
    monkeypatch.setattr(BM, "bm25_grid", lambda *a: grid(*a, cell_postings=cells[0], cell_terms=cells[1]))
    k_max = None if isinstance(k, int) else 4
    want = rows(BM.bm25_search(q, index, k, k_max, per_level, grid_hits=None))
    assert want and rows(BM.bm25_search(q, index, k, k_max, per_level, grid_hits=0)) == want


@pytest.mark.parametrize("share", [0.0, 10.0])
def test_products_and_single_postings_agree(tables, monkeypatch, share):
    """All tokens in the table, or none of them."""
    q, index = tables
    cell = BM._best_of_cell
    monkeypatch.setattr(BM, "_DENSE_SHARE", share)
    monkeypatch.setattr(BM, "_HELD", 700)
    import numpy as np
    import pandas as pd
    c = pd.DataFrame({"chunk_id": ["b", "a", "c"], "doc_len": [2, 1, 3], "avgdl": 2.0, "codes": [[], [], []],
                      "tokens": [[1, 2], [2], [3, 2]], "tfs": [[1, 1], [1], [2, 1]]})
    asked = pd.DataFrame({"query_id": [7, 8, 9], "academic_level": "pg", "f_code": 0, "tokens": [[2], [1, 3, 5], [5]],
                          "weights": [[1.0], [2.0, 1.0, 4.0], [1.0]]})
    got = cell(asked, c, 2, 1.5, 0.75, [])
    norm = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    want = [(7, "a", norm(1, 1)), (7, "b", norm(1, 2)), (8, "b", 2 * norm(1, 2)), (8, "c", norm(2, 3))]
    assert list(zip(got["query_id"], got["chunk_id"])) == [w[:2] for w in want]
    assert np.allclose(got["score"], [w[2] for w in want])


def test_only_the_best_of_a_cell_leave_it(tables, monkeypatch):
    """Before, every pair of a question and a chunk that share a token was a row."""
    q, index = tables
    monkeypatch.setattr(BM, "LEAST_POSTINGS", 10 ** 6)
    left = BM.bm25_grid(q, index, 2)
    assert left.groupBy("query_id", "academic_level").count().agg(F.max("count")).first()[0] <= 2
    assert BM.bm25_scores(q, index).count() > 10 * left.count()


def test_tokens_of_a_chunk_are_cut_before_its_hits_are_joined(spark):
    """Before, each hit cut the text of its chunk again; scores are the same."""
    from leafquery.operators.fuse import fuse_legs
    from leafquery.operators.rerank import rerank, with_overlap
    chunks = spark.createDataFrame([("a", " Fee of the chair,\nfee ", 1), ("b", "", 2), ("c", None, 2), ("d", "ÉTION dans lab", 3)],
                                   "chunk_id string, text string, page int").selectExpr(
        "*", *[f"cast(null as string) as {n}" for n in ("heading", "heading_path", "department", "program", "section")])
    hits = spark.createDataFrame([(q, leg, c, r) for q in (1, 2, 3) for leg in ("dense", "sparse") for r, c in enumerate("abcd")],
                                 "query_id long, leg string, chunk_id string, rank int")
    q = spark.createDataFrame([(1, "fee of chairman"), (2, "dans"), (3, "?")], "query_id long, text string").selectExpr(
        "*", *[f"cast(null as string) as {n}" for n in ("department", "program", "section", "entity", "year_level")])

    def scored(rows):
        return sorted((r.query_id, r.chunk_id, r.text or "", r.rerank_score, r.rerank_rank) for r in rerank(fuse_legs(rows), q, 2).collect())

    early = with_overlap(hits, q, chunks)
    got = scored(early)
    assert got == scored(chunks.join(hits, "chunk_id")) and len({r[3] for r in got}) > 4
    plan = early._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("AS _tokens#") > plan.index("Join")
