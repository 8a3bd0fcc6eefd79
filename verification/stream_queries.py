"""The given tables replayed as streams; results are read back from the sink folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from leafquery.functions.staging import shared_folder
from leafquery.operators.reuse import exact_key
from leafquery.streaming import streams as ST

from . import fixtures as fx
from .fixtures import QUESTIONS_SQL, questions, shown, shown_sql, table
from .ingest_queries import PAGES_SQL, TRIM
from .question_queries import (B, E, N, PG_OPEN, QS, UG_OPEN, intents, prototypes, status, with_vectors, SQL as QSQL,
                               SECTION_SQL, ENTITY_SQL, SEMESTER_SQL, FEE_SQL, REWRITE_SQL)
from .retrieval_queries import SQL as RSQL, asked_questions, corpus

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def folders(spark, *names):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return [f"{base}/{n}" for n in names]


def clock():
    """Event time of a turn: one minute each."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts")


def replay(spark, df, path, batches: int = 2):
    """Write the rows as files and read them as a stream, in micro-batches of one file for each core."""
    cores = spark.sparkContext.defaultParallelism
    df.repartition(batches * cores).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", cores).parquet(path)


@query("stream_ingest")
def _(spark, sf):
    source, chunks_path, status_path, checkpoint = folders(spark, "in", "chunks", "status", "checkpoint")
    p = fx.pages(spark, sf)
    counts = p.groupBy("academic_level").agg(F.count("*").alias("upload_pages"))
    uploads = p.join(counts, "academic_level").withColumn("upload_id", F.lit(1).cast("long")).select(*ST.UPLOAD_SCHEMA.names)
    cores = spark.sparkContext.defaultParallelism
    uploads.repartition(3 * cores, "doc_id").write.parquet(source)
    # a third of the files for each batch: a level is complete only with the last
    ST.stream_ingest(ST.read_uploads(spark, source, files_per_batch=cores), chunks_path, status_path, checkpoint,
                     available_now=True).awaitTermination()
    done = spark.read.parquet(chunks_path).groupBy("academic_level").agg(
        F.countDistinct("doc_id").alias("docs"), F.countDistinct("page").alias("pages"))
    return done.join(ST.current_status(spark, status_path), "academic_level").select(
        "academic_level", "ingestion_status", "docs", "pages")


SQL["stream_ingest"] = f"""select academic_level, 'completed' as ingestion_status, count(distinct doc_id) as docs, count(distinct page_no) as pages
 from {PAGES_SQL} group by 1"""


@query("stream_labels", f"""{QS} select query_id, regexp_matches(lower(text), '{PG_OPEN}') as is_pg, regexp_matches(lower(text), '{UG_OPEN}') as is_ug,
 {shown_sql(SECTION_SQL, 'section')}, {shown_sql(ENTITY_SQL, 'entity')}, {shown_sql(SEMESTER_SQL, 'semester')}, {shown_sql(FEE_SQL, 'fee_type')}, {REWRITE_SQL} as needs_rewrite from q""")
def _(spark, sf):
    source, out, checkpoint = folders(spark, "in", "out", "checkpoint")
    labelled = ST.stream_labels(replay(spark, questions(spark, sf), source))
    ST.run_to_folder(labelled, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("query_id", "is_pg", "is_ug", *[
        shown(c, c) for c in ("section", "entity", "semester", "fee_type")], "needs_rewrite")


@query("stream_route", f"""select r.query_id, r.intent, r.seat_route, l.is_pg, l.is_ug from ({QSQL['route_seat']}) r
 join ({QSQL['level_from_history']}) l using (query_id) join embeddings e on e.vec_id = cast(floor(r.query_id / 1000) as bigint)""")
def _(spark, sf):
    source, out, checkpoint = folders(spark, "in", "out", "checkpoint")
    q = with_vectors(spark, sf, questions(spark, sf)).withColumn("use_pg", F.col("query_id") % 2 == 0)
    from leafquery.operators.vocab import keyword_vocab
    ST.stream_route(replay(spark, q, source), fx.turns(spark, sf), prototypes(spark, sf),
                    keyword_vocab(fx.chunks(spark, sf)), status(spark, sf), out, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(out).select("query_id", "intent", shown("seat_route", "seat_route"), "is_pg", "is_ug")


# the key of a question is its text and the turn before it; all are asked twice, and an answer names the question it was made for
@query("stream_exact_reuse", f"""with t as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations),
 o as (select conv_id * 1000 + turn as query_id, turn < 2 as early, md5(concat(lower(trim(text, {TRIM})), '|', coalesce(before, ''))) as key from t where role = 'user'),
 k as (select * from o union all select query_id + 1000000000000, false, key from o)
 select query_id, key, concat('answer to ', cast(first_value(query_id) over w as string)) as answer, row_number() over w > 1 as hit
 from k window w as (partition by key order by not early, query_id)""")
def _(spark, sf):
    source, out, checkpoint = folders(spark, "in", "out", "checkpoint")
    t = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    once = t.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("turn") < 2).alias("early"),
                                            exact_key(F.col("text"), F.col("before")).alias("key"), clock())
    again = once.withColumn("query_id", F.col("query_id") + 1_000_000_000_000).withColumn("early", F.lit(False))
    q = once.unionByName(again).withColumn("answer", F.concat(F.lit("answer to "), F.col("query_id").cast("string")))
    # the others come after a restart from the checkpoint: their keys meet the state or each other
    for part, mode in (("early", "error"), ("not early", "append")):
        q.filter(part).drop("early").write.mode(mode).parquet(source)
        stream = spark.readStream.schema(q.drop("early").schema).parquet(source)
        ST.run_to_folder(ST.stream_exact_reuse(stream), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("query_id", "key", "answer", "hit")


@query("stream_history", f"""with t as (select q.conv_id, q.turn, c.role, c.text, c.turn as t2 from conversations q left join conversations c on c.conv_id = q.conv_id
   and c.turn < q.turn and c.turn >= q.turn - 4)
 select conv_id, turn, cast(count(role) as int) as n_turns, md5(coalesce(string_agg(case when role is not null then
   concat(case when role = 'user' then 'User: ' else 'Assistant: ' end, text) end, chr(10) order by t2), '')) as md5 from t group by 1, 2""")
def _(spark, sf):
    source, out, checkpoint = folders(spark, "in", "out", "checkpoint")
    t = table(spark, sf, "conversations").select("*", clock())
    # early turns come before the others, in any order over several files of one batch
    files = max(3, spark.sparkContext.defaultParallelism)
    t.filter("turn < 2").repartition(files, "turn", "text").write.parquet(source)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", files).parquet(source)
    ST.run_to_folder(ST.stream_history(stream, 4), out, checkpoint).awaitTermination()
    t.filter("turn >= 2").repartition(files, "turn", "text").write.mode("append").parquet(source)
    # started again from its checkpoint, with the state it left
    ST.run_to_folder(ST.stream_history(stream, 4), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "n_turns", F.md5("history").alias("md5"))


@query("stream_retrieve", RSQL["retrieve"])
def _(spark, sf):
    source, out, checkpoint = folders(spark, "in", "out", "checkpoint")
    q = asked_questions(spark, sf)
    ST.stream_retrieve(replay(spark, q, source), corpus(spark, sf), out, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(out).select("query_id", F.md5("context").alias("md5"), F.length("context").alias("n_chars"))
