"""Table maintenance and the restart behaviour of streams."""

from pyspark.sql import functions as F

from leafquery.sources import tables as ST
from leafquery.streaming import streams as SS


def test_upsert_new_row_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "chunk_id string, seq long, v string")
    new = spark.createDataFrame([("b", 2, "p"), ("b", 3, "q"), ("c", 2, "r")], "chunk_id string, seq long, v string")
    once = ST.upsert_by_id(old, new)
    twice = ST.upsert_by_id(once, new)
    want = [("a", "x"), ("b", "q"), ("c", "r")]
    assert sorted((r.chunk_id, r.v) for r in once.collect()) == want == sorted((r.chunk_id, r.v) for r in twice.collect())


def test_status_upsert_touches_named_columns_only(spark):
    schema = "academic_level string, excluded_pages array<int>, ingestion_status string, ingestion_error string"
    table = spark.createDataFrame([("ug", [1, 2], "failed", "boom")], schema)
    new = spark.createDataFrame([("ug", "completed", None), ("pg", "processing", None)],
                                "academic_level string, ingestion_status string, ingestion_error string")
    out = ST.upsert_status(table, new)
    got = {r.academic_level: (r.excluded_pages, r.ingestion_status, r.ingestion_error) for r in out.collect()}
    assert got == {"ug": ([1, 2], "completed", None), "pg": ([], "processing", None)}
    levels = spark.createDataFrame([("ug",), ("xx",)], "academic_level string")
    assert {r.academic_level: r.ingestion_status for r in ST.read_status(table, levels).collect()} == {"ug": "failed", "xx": "idle"}


def test_snapshot_round_trip(spark, tmp_path):
    cache = spark.createDataFrame([(1, "k", "ä\n\"q\"")], "seq long, key string, answer string")
    ST.save_snapshot(cache, str(tmp_path / "c"))
    assert ST.load_snapshot(spark, str(tmp_path / "c"), cache.schema).collect() == cache.collect()
    assert ST.load_snapshot(spark, str(tmp_path / "none"), cache.schema).count() == 0


def test_upload_over_many_batches_replaces_its_level_once(spark, tmp_path):
    source, chunks, status, checkpoint = (str(tmp_path / n) for n in ("in", "chunks", "status", "ck"))

    def send(rows):
        spark.createDataFrame(rows, SS.UPLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        SS.stream_ingest(SS.read_uploads(spark, source, files_per_batch=1), chunks, status, checkpoint, available_now=True).awaitTermination()
        texts = sorted((r.academic_level, r.text) for r in spark.read.parquet(chunks).select("academic_level", "text").collect())
        return texts, {r.academic_level: r.ingestion_status for r in SS.current_status(spark, status).collect()}

    ug, pg = "undergraduate", "postgraduate"
    send([(1, ug, 2026, 1, "one", 1, 3), (2, pg, 2026, 1, "pg", 1, 1)])
    send([(1, ug, 2026, 2, "two", 1, 3)])
    send([(1, ug, 2026, 3, "three", 1, 3)])
    first = [(pg, "## Page 1  \npg"), (ug, "## Page 1  \none"), (ug, "## Page 2  \ntwo"), (ug, "## Page 3  \nthree")]
    assert run() == (sorted(first), {ug: "completed", pg: "completed"})
    assert run() == (sorted(first), {ug: "completed", pg: "completed"})  # a restart adds nothing
    send([(3, ug, 2026, 1, "new", 2, 2)])
    assert run() == (sorted(first), {ug: "processing", pg: "completed"})  # not complete: the old level stays
    send([(3, ug, 2026, 2, "newer", 2, 2)])
    assert run() == (sorted([first[0], (ug, "## Page 1  \nnew"), (ug, "## Page 2  \nnewer")]), {ug: "completed", pg: "completed"})


def test_history_of_many_small_arrow_batches_is_in_order(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    turns = spark.range(60).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                   F.concat(F.lit("t"), "id").alias("text"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"))
    turns.orderBy(F.rand(3)).repartition(3).write.parquet(source)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        SS.run_to_folder(SS.stream_history(spark.readStream.schema(schema).parquet(source), 2), out, checkpoint).awaitTermination()
        late = spark.createDataFrame([(7, 5, "user", "again")], "conv_id long, turn long, role string, text string")
        late.withColumn("ts", F.timestamp_seconds(F.lit(1059))).write.mode("append").parquet(source)
        SS.run_to_folder(SS.stream_history(spark.readStream.schema(schema).parquet(source), 2), out, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.turn, r.history) for r in rows if not r.late) == [
        (t, "\n".join(f"User: t{k}" for k in range(max(0, t - 2), t))) for t in range(60)]
    assert [(r.turn, r.history) for r in rows if r.late] == [(5, None)]


def test_state_expires_with_event_time(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def send(rows):
        df = spark.createDataFrame(rows, "key string, query_id long, answer string, t long")
        (df.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(source))
        stream = spark.readStream.schema("key string, query_id long, answer string, ts timestamp").parquet(source)
        SS.run_to_folder(SS.stream_exact_reuse(stream, "10 seconds", 60_000), out, checkpoint).awaitTermination()

    send([("a", 1, "one", 1000), ("a", 2, "two", 1001)])
    send([("a", 3, "three", 1030), ("b", 4, None, 1031)])
    send([("z", 5, "far", 9000)])   # moves the watermark past every time to live
    send([("a", 6, "new", 9001)])
    got = {r.query_id: (r.answer, r.hit) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("one", False), 2: ("one", True), 3: ("one", True), 4: (None, False), 5: ("far", False), 6: ("new", False)}


def test_pages_of_complete_uploads_go_and_a_replayed_batch_finds_its_own(spark, tmp_path):
    source, chunks, status, checkpoint = (str(tmp_path / n) for n in ("in", "chunks", "status", "ck"))
    gathered = tmp_path / "ck-pages"

    def run(*files):
        for rows in files:
            spark.createDataFrame(rows, SS.UPLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        SS.stream_ingest(SS.read_uploads(spark, source, files_per_batch=1), chunks, status, checkpoint, available_now=True).awaitTermination()
        held = sorted(tuple(r) for r in spark.read.parquet(str(gathered)).select("academic_level", "text").collect())
        return held, sorted(r.text for r in ST.read_or_empty(spark, chunks, "parquet", ST.CHUNK_SCHEMA).collect())

    page = lambda level, number, text, upload, pages: (upload, level, 2026, number, text, upload, pages)
    run([page("undergraduate", 1, "one", 1, 2)])
    held, texts = run([page("undergraduate", 2, "two", 1, 2)])
    assert [t for _, t in held] == ["one", "two"]  # complete, but its batch may still be replayed
    last = max((int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit()))
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    assert run() == (held, texts) and len(texts) == 2
    held, texts = run([page("a/b=c", 1, "other", 2, 5)])
    assert held == [("a/b=c", "other")] and len(texts) == 2  # only the upload that is not complete
    assert not list((tmp_path / "ck-pages-done").glob("batch_id=*"))


def test_reuse_over_small_arrow_batches_holds_numbers_only(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "key string, query_id long, answer string, ts timestamp"
    rows = spark.range(40).select(F.lit("k").alias("key"), F.col("id").alias("query_id"),
                                  F.when(F.col("id") >= 5, F.concat(F.lit("a"), "id")).alias("answer"), F.timestamp_seconds(F.lit(1000)).alias("ts"))
    extra = rows.filter("query_id = 5").unionByName(rows.filter("query_id = 7").withColumn("query_id", F.lit(None).cast("long")))
    extra = extra.unionByName(rows.filter("query_id = 1").withColumn("key", F.lit("never answered")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for batch in (rows.unionByName(extra).orderBy(F.rand(5)), rows.filter("query_id = 3")):
            batch.coalesce(1).write.mode("append").parquet(source)
            SS.run_to_folder(SS.stream_exact_reuse(spark.readStream.schema(schema).parquet(source)), out, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sorted((r.key, -1 if r.query_id is None else r.query_id, r.answer or "", r.hit) for r in spark.read.parquet(out).collect())
    want = [("k", i, "", False) for i in range(5)] + [("k", 5, "a5", False), ("k", 5, "a5", True)]
    want += [("k", i, "a5", True) for i in range(6, 40)] + [("k", -1, "a5", True), ("k", 3, "a5", True), ("never answered", 1, "", False)]
    assert got == sorted(want)
