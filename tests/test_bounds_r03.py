"""What grows with the input is neither broadcast nor held at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafquery.operators import bm25, dense, understand as U


def names_plan(spark):
    q = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("who leads the department of src"), "id").alias("text"))
    aliases = spark.createDataFrame([("department", "Department of src3", "department of src3"), ("department", "Department of src3", "src3"),
                                     ("faculty", "Faculty of en", "faculty of en")], "kind string, name string, alias string")
    found = U.detect_names(q, aliases)
    assert {r.query_id: r.department for r in found.collect()} == {i: "Department of src3" for i in (3, *range(30, 40))}
    return found._jdf.queryExecution().sparkPlan().toString()


def test_substrings_of_questions_are_not_broadcast(spark):
    joins = [line for line in names_plan(spark).splitlines() if "Join [_n" in line]
    assert joins and all("BroadcastHashJoin" in j and "BuildRight" in j for j in joins[:1])


def test_many_aliases_meet_the_questions_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_ALIASES", 0)
    joins = [line for line in names_plan(spark).splitlines() if "Join [_n" in line]
    assert joins and "SortMergeJoin" in joins[0]


@pytest.mark.parametrize("n, width", [(1, 1), (1000, 1), (1000, 8192), (3, 5_000_000), (0, 7)])
def test_products_are_cut_into_bounded_slices(n, width):
    cuts = list(dense._row_slices(n, width))
    assert np.concatenate([np.arange(n)[c] for c in cuts] or [np.zeros(0, int)]).tolist() == list(range(n))
    assert all((c.stop - c.start) * width <= max(1 << 20, width) for c in cuts)


def test_slices_change_no_similarity(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), "seat" if i % 2 else "general") for i in range(60)]
    df = spark.createDataFrame(rows, "query_id long, vec array<double>, class string")

    def answers():
        best = dense.max_similarity(df, df, ("seat", "general")).orderBy("query_id").collect()
        near = dense.knn_search(df.select("query_id", "vec"), df.select(F.col("query_id").alias("chunk_id"), "vec"), 3)
        return ([(r.query_id, round(r.seat_sim, 9), round(r.general_sim, 9)) for r in best],
                sorted((r.query_id, r.rank, r.chunk_id) for r in near.collect()))

    whole = answers()
    monkeypatch.setattr(dense, "_MATMUL_CELLS", 7)
    assert answers() == whole


def test_small_cells_do_not_copy_a_large_group_without_end(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 2) for i in range(400)], "id long, vec array<double>, label int")
    q, c = df.select(F.col("id").alias("query_id"), "vec", "label"), df.select(F.col("id").alias("chunk_id"), "vec", "label")

    def answers(**options):
        return sorted((r.query_id, r.rank, r.chunk_id) for r in dense.knn_search(q, c, 3, level="label", **options).collect())

    sizes = spark.sparkContext.accumulator(0)
    best = dense._best_of_block

    def counted(a, b, k):
        sizes.add(len(a) + len(b))
        return best(a, b, k)

    monkeypatch.setattr(dense, "_best_of_block", counted)
    found = answers(broadcast_rows=0, cell_rows=2, cell_queries=2)
    read = sizes.value
    monkeypatch.undo()
    assert found == answers()
    assert 800 <= read <= 2 * 400 * dense.COPIES


def test_counting_tasks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("chunk_id"), F.lit("en").alias("academic_level"),
                                   F.concat(F.lit("one two "), (F.col("id") % 7).cast("string")).alias("text"))
    q = spark.createDataFrame([(1, "en", "one 3"), (2, "en", "5 two two")], "query_id long, academic_level string, text string")

    def answers():
        index = bm25.bm25_index(docs, staged=True)
        hits = bm25.bm25_search(q, index, 4).collect()
        return index.parts, sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in hits)

    few, found = answers()
    monkeypatch.setattr(bm25, "TASK_BYTES", 100)
    many, again = answers()
    assert few == spark.sparkContext.defaultParallelism and many == 27 and again == found
    assert bm25.bm25_index(docs).postings.rdd.getNumPartitions() == many


def test_the_index_counts_its_tokens_once(spark):
    docs = spark.createDataFrame([(1, "en", "chairman and dept"), (2, "en", None), (3, "de", ""), (4, None, "a b")], "chunk_id long, academic_level string, text string")
    index = bm25.bm25_index(docs)
    table = index.terms.join(index.corpus, "academic_level")
    assert table._jdf.queryExecution().optimizedPlan().toString().count("explode(") <= 1
    assert sorted((r.token, r.df, r.n, r.avgdl) for r in table.collect()) == [
        ("and", 1, 2, 1.5), ("chairperson", 1, 2, 1.5), ("department", 1, 2, 1.5)]
    assert {r.academic_level: (r.n, r.avgdl) for r in index.corpus.collect()} == {"en": (2, 1.5), "de": (1, 0.0), None: (1, 2.0)}


def test_postings_that_nobody_asks_for_are_not_dealt_by_token(spark):
    docs = spark.range(200).select(F.col("id").alias("chunk_id"), F.lit("en").alias("academic_level"),
                                   F.concat(F.lit("one two "), (F.col("id") % 7).cast("string")).alias("text"))
    q = spark.createDataFrame([(1, "en", "two 3")], "query_id long, academic_level string, text string")
    index = bm25.bm25_index(docs, rows_per_shard=10, staged=True)
    scores = bm25.bm25_scores(q, index, broadcast_terms=0)
    assert "LeftSemi" in scores._jdf.queryExecution().optimizedPlan().toString()
    near = bm25.bm25_scores(q, index)
    assert sorted((r.chunk_id, round(r.score, 9)) for r in scores.collect()) == sorted((r.chunk_id, round(r.score, 9)) for r in near.collect())


def test_scoring_tasks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """the chunks that a search scores are dealt to as many tasks as counted them, more for many question terms."""
    docs = spark.range(300).select(F.col("id").alias("chunk_id"), F.lit("en").alias("academic_level"),
                                   F.concat(F.lit("one two "), (F.col("id") % 7).cast("string")).alias("text"))
    q = spark.createDataFrame([(1, "en", "one 3"), (2, "en", "5 two two")], "query_id long, academic_level string, text string")
    monkeypatch.setattr(bm25, "TASK_BYTES", 100)
    index = bm25.bm25_index(docs, staged=True)
    assert index.parts == 27
    for terms, tasks in ((100, 27), (2, 54)):
        monkeypatch.setattr(bm25, "TERMS_PER_TASK", terms)
        assert bm25.bm25_scores(q, index).rdd.getNumPartitions() == tasks
