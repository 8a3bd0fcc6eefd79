"""F3 to F6: cells compare questions with the chunks that their filters leave, and large filtered searches go through cells."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafquery.operators import bm25 as BM, dense


@pytest.mark.parametrize("width, k, ties", [(1, 3, False), (40, 3, True), (500, 2, False), (500, 4, True), (517, 400, False)])
@pytest.mark.parametrize("masked", [False, True])
def test_best_pairs_are_those_of_a_full_sort(width, k, ties, masked):
    rng = np.random.default_rng(width + k)
    score = rng.integers(-3, 4, (30, width)) / 2 if ties else rng.normal(size=(30, width))
    ok = rng.random(score.shape) < 0.3 if masked else np.ones(score.shape, bool)
    row, column = dense.best_pairs(score, ok if masked else None, k, 0.1)
    want = [(r, c) for r in range(30) for c in sorted(np.flatnonzero(ok[r] & (score[r] >= 0.1)),
                                                      key=lambda c: (-np.round(score[r, c], 6), c))[:k]]
    assert list(zip(row.tolist(), column.tolist())) == want


def test_rounded_ties_at_the_floor_go_by_column():
    score = np.zeros((1, 200))
    score[0, [3, 150, 199]] = [0.5 - 4e-7, 0.5, 0.5 + 4e-7]
    assert dense.best_pairs(score, None, 2)[1].tolist() == [3, 150]


@pytest.mark.parametrize("least", [1, 3, 10 ** 6])
def test_groups_of_questions_and_masks_leave_the_same_rows(monkeypatch, least):
    monkeypatch.setattr(dense, "_LEAST_ASKED", least)
    rng = np.random.default_rng(8)
    n, m = 60, 90
    wanted, have = [rng.integers(0, 3, n), rng.integers(0, 2, n)], [rng.integers(0, 3, m), rng.integers(0, 3, m)]
    code, codes = rng.integers(0, 3, n) * rng.integers(0, 2, n), pd.Series([rng.integers(1, 5, rng.integers(0, 3)).tolist() for _ in range(m)])
    filters = dense.Filters(wanted, have, code, dense.rows_of_code(codes), m)
    ok = np.array([[all(w[q] in (0, h[c]) for w, h in zip(wanted, have)) and (code[q] == 0 or code[q] in codes[c]) for c in range(m)]
                   for q in range(n)])
    assert (filters.allowed(np.arange(n)) == ok).all()
    seen = []
    for questions, columns in filters.groups():
        seen += questions.tolist()
        if columns is not None:
            assert (ok[questions] == np.isin(np.arange(m), columns)).all()
    assert sorted(seen) == list(range(n))


def test_questions_meet_only_the_vectors_that_their_filter_leaves(monkeypatch):
    """Before, every question was multiplied with every vector of its group."""
    rng = np.random.default_rng(2)
    made = []
    best = dense.best_pairs
    monkeypatch.setattr(dense, "best_pairs", lambda score, *a: made.append(score.size) or best(score, *a))
    none = np.zeros(160, np.int64)
    c = pd.DataFrame({"cid": np.arange(160), "vec": list(rng.normal(size=(160, 4))), "grp": 1, "department": none,
                      "section": 1 + np.arange(160) % 8, "faculty": none, "codes": [[]] * 160})
    q = pd.DataFrame({"qid": np.arange(80), "vec": list(rng.normal(size=(80, 4))), "grp": 1, "f_department": none[:80],
                      "f_section": 1 + np.arange(80) % 2, "f_faculty": none[:80], "f_code": none[:80]})
    found = dense._best_of_block(q, c, 3)
    cosine = dense._unit(q["vec"]) @ dense._unit(c["vec"]).T
    for r in range(80):
        of_section = np.flatnonzero(c["section"] == q["f_section"][r])
        want = of_section[np.argsort(-np.round(cosine[r, of_section], 6), kind="stable")][:3]
        assert found.loc[found["qid"] == r, "cid"].tolist() == want.tolist()
    assert sum(made) == 80 * 160 // 8


def test_many_filtered_questions_go_through_cells(spark, monkeypatch):
    """Before, a search that was not asked for cells made a row for each question term and posting."""
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(6)
    c = spark.createDataFrame([(f"c{i}", "ug", f"d{i % 3}", " ".join(rng.choice(words, 9))) for i in range(60)],
                              "chunk_id string, academic_level string, department string, text string")
    q = spark.createDataFrame([(i, "ug", f"d{i % 3}" if i % 2 else None, " ".join(rng.choice(words, 6))) for i in range(90)],
                              "query_id long, academic_level string, f_department string, text string")
    calls, grid = [], BM.bm25_grid
    monkeypatch.setattr(BM, "GRID_HITS", 100)
    monkeypatch.setattr(BM, "bm25_grid", lambda *a, **b: calls.append(1) or grid(*a, **b))
    index = BM.bm25_index(c, staged=True)

    def rows(df):
        return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())

    got = rows(BM.bm25_search(q, index, 4))
    assert calls and got == rows(BM.bm25_search(q, index, 4, grid_hits=None)) and len(calls) == 1
    BM.bm25_search(q.limit(3), index, 4)  # few questions: postings are met as they are
    assert len(calls) == 1


def test_terms_that_are_not_broadcast_meet_postings_in_cells(spark):
    """before, a score for each question, chunk and partition of its tokens was shuffled. Ids may be missing and repeat."""
    docs = spark.createDataFrame([(None if i % 9 == 4 else i // 2, "en" if i % 4 else None, f"one two w{i % 7}") for i in range(120)],
                                 "chunk_id long, academic_level string, text string")
    q = spark.createDataFrame([(1, "en", "two w3"), (None, "en", "w5 two two"), (3, None, "one"), (4, "en", "never"), (5, "en", None)],
                              "query_id long, academic_level string, text string")
    index = BM.bm25_index(docs, rows_per_shard=10, staged=True)

    def rows(df):
        return sorted((str(r.query_id), r.academic_level, r["rank"], str(r.chunk_id), round(r.score, 6)) for r in df.collect())

    found = BM.bm25_search(q, index, 4, broadcast_terms=0)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == rows(BM.bm25_search(q, index, 4, broadcast_terms=0, grid_hits=None)) == rows(BM.bm25_search(q, index, 4))
    assert len(rows(found)) == 8
