"""The life of a question table: reuse first, then routes, then messages with a context."""

from leafquery.functions.staging import stage
from leafquery.operators.embed import embed
from leafquery.operators.history import history_digest
from leafquery.operators.reuse import exact_key
from leafquery.plans.answer import answer_inputs
from leafquery.plans.ingest import build_corpus, chunks_of_pages
from leafquery.sources.pages import PAGE_SCHEMA
from pyspark.sql import functions as F


def test_reused_routed_and_prompted(spark):
    pages = [(1, "undergraduate", 2026, 1, "# Department of Computing\nDean Dr. Alpha Beta\n## Fees\nTuition fee Rs. 1,200 only")]
    corpus = build_corpus(stage(chunks_of_pages(spark.createDataFrame(pages, PAGE_SCHEMA))), staged=True)
    rows = [(1, 10, 0, "Who is the dean of computing?"), (2, 20, 0, "how many seats for BS"), (3, 30, 2, "what about its fee"),
            (4, 40, 0, "What is  the tuition"), (5, 50, 0, "WHO is the dean of Computing? ")]
    q = stage(embed(spark.createDataFrame(rows, "query_id long, conv_id long, turn int, text string")).withColumn("use_pg", F.lit(True)))
    turns = spark.createDataFrame([(30, 0, "user", "tell me about masters"), (30, 1, "assistant", "x" * 300)],
                                  "conv_id long, turn int, role string, text string")
    proto = embed(spark.createDataFrame([("seat", "seats available"), ("general", "hello there")], "class string, text string"))
    status = spark.createDataFrame([("undergraduate", [3], "completed", None)],
                                   "academic_level string, excluded_pages array<int>, ingestion_status string, ingestion_error string")
    keyed = q.join(history_digest(q, turns), "query_id")
    exact = keyed.filter("query_id = 5").select(exact_key(F.col("text"), F.col("history")).alias("key"), F.lit("cached").alias("answer"))
    near = keyed.filter("query_id = 4").select(F.lit(1).cast("long").alias("seq"), "history", "vec", F.lit("near").alias("answer"))
    got = {r.query_id: r for r in answer_inputs(q, turns, corpus, proto, status, exact, near).collect()}
    assert got[1].answer == "cached" and got[1].reused == "exact" and got[1].messages is None
    assert got[5].reused == "exact"
    assert got[4].answer == "near" and got[4].reused == "semantic"
    assert got[2].intent == "SEAT" and got[2].seat_route == "UG_LINK" and got[2].messages is None
    three = got[3]
    assert three.intent == "RAG" and three.needs_rewrite and three.answer is None
    assert [m.role for m in three.messages] == ["system", "user", "assistant", "user"]
    assert three.messages[2].content == "x" * 250 + "... [truncated]"
    assert three.messages[-1].content == "what about its fee"


def test_rewritten_text_is_searched(spark):
    from leafquery.plans.answer import rewritten_questions

    rows = [(1, 30, 2, "what about its fee"), (2, 31, 0, "phd fee"), (3, 32, 2, "and its dean?")]
    q = spark.createDataFrame(rows, "query_id long, conv_id long, turn int, text string")
    turns = spark.createDataFrame([(30, 1, "user", "tell me about computing")], "conv_id long, turn int, role string, text string")

    def rewriter(asked):
        return asked.filter("query_id = 1").select("query_id", F.concat(F.lit('"Rewritten query: fee, after '), "transcript", F.lit('"')).alias("rewritten"))

    got = {r.query_id: r.search_text for r in rewritten_questions(q, turns, rewriter, {"phd": "doctorate"}).collect()}
    assert got == {1: "fee, after User: tell me about computing", 2: "doctorate fee", 3: "and its dean?"}
    assert {r.query_id: r.search_text for r in rewritten_questions(q, turns).collect()} == {r[0]: r[3] for r in rows}
