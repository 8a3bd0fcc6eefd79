"""Arrival paths as Structured Streaming: uploads, questions, reuse and conversation state.

Every sink is a folder with one partition per micro-batch that is overwritten when a batch is
replayed, so a restart from the checkpoint adds nothing.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as fv
from ..functions.staging import remove_folder
from ..operators.bm25 import rich_text, searchable
from ..operators.segments import SegmentedIndex
from ..operators.understand import (academic_level, detect_course, detect_entity, detect_fee_type, detect_person,
                                    detect_section, detect_semester, detect_year_level, is_identity_question,
                                    needs_rewrite, strategy_name, strategy_table)
from ..plans.answer import route
from ..plans.ingest import Corpus, chunks_of_pages
from ..plans.retrieve import retrieve
from ..sources.pages import PAGE_SCHEMA
from ..sources.tables import CHUNK_SCHEMA, read_or_empty, replace_level

STATUS_LOG_SCHEMA = T.StructType([
    T.StructField("academic_level", T.StringType()), T.StructField("ingestion_status", T.StringType()),
    T.StructField("ingestion_error", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("step", T.IntegerType())])


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str,
         available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- uploads ----------------------------------------------------------------
UPLOAD_SCHEMA = T.StructType([*PAGE_SCHEMA.fields, T.StructField("upload_id", T.LongType()),
                              T.StructField("upload_pages", T.LongType())])


def read_uploads(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """Pages as they arrive. Each names its upload and how many pages that has, in any number of files."""
    return (spark.readStream.schema(UPLOAD_SCHEMA).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path))


def _log_status(levels: DataFrame, path: str, batch_id: int, step: int, status: Column | str, error: str | None = None) -> None:
    status = F.lit(status) if isinstance(status, str) else status
    (levels.select("academic_level", status.alias("ingestion_status"),
                   F.lit(error).cast("string").alias("ingestion_error"), F.lit(batch_id).cast("long").alias("batch_id"),
                   F.lit(step).alias("step"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "step").parquet(path))


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """Latest status per level from the log."""
    log = read_or_empty(spark, path, "parquet", STATUS_LOG_SCHEMA)
    last = log.groupBy("academic_level").agg(F.max_by(
        F.struct("ingestion_status", "ingestion_error"), F.struct("batch_id", "step")).alias("_s"))
    return last.select("academic_level", "_s.*")


GATHERED_SCHEMA = T.StructType([*UPLOAD_SCHEMA.fields, T.StructField("upload", T.StringType()),
                                T.StructField("batch_id", T.LongType())])
DONE_SCHEMA = T.StructType([T.StructField("upload", T.StringType()), T.StructField("batch_id", T.LongType())])
#: uploads of one batch whose folders are named one by one; of more, all gathered pages are read
LISTED_UPLOADS = 10_000


def _upload_key() -> Column:
    """Folder name of an upload: a level may be any string."""
    return F.concat(F.lit("u"), F.md5(F.to_json(F.struct("academic_level", "upload_id"))))


def _forget(spark: SparkSession, gathered: str, batch_id: int) -> None:
    """Remove the pages of uploads that an earlier batch has completed: this one runs, so that one is committed."""
    done = read_or_empty(spark, f"{gathered}-done", "parquet", DONE_SCHEMA).filter(F.col("batch_id") < batch_id)
    batches = set()
    for row in done.distinct().toLocalIterator():
        remove_folder(spark, f"{gathered}/upload={row.upload}")
        batches.add(row.batch_id)
    for b in sorted(batches):
        remove_folder(spark, f"{gathered}-done/batch_id={b}")


def stream_ingest(pages: DataFrame, chunks_path: str, status_path: str, checkpoint: str, available_now: bool = False,
                  index_path: str | None = None, **chunk_options) -> StreamingQuery:
    """A complete upload replaces its level; the status goes processing -> completed or failed.

    An upload may arrive over any number of micro-batches: its pages are gathered beside the checkpoint, in a
    folder of the upload with one partition for each batch (written anew when a batch is replayed), and its level is replaced
    by the batch that brings its last page. A batch reads the folders of its own uploads only. The
    pages of a complete upload are removed by the next batch, since the one that completed it may be replayed until
    then; pages that come for it later begin it anew. Of several complete uploads of a level the one with the largest
    upload_id counts. With ``index_path`` the keyword index and the vocabularies there (``SegmentedIndex``) get the same
    levels before the status says completed; other levels are not counted again, and a batch that is
    replayed replaces them once more, by the same rows. A failure to build the chunks is logged in full and raised, so that the batch is
    tried again.
    """
    gathered = f"{checkpoint}-pages"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _forget(spark, gathered, batch_id)
        pages = batch.withColumn("upload", _upload_key())
        (pages.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("upload", "batch_id").parquet(gathered))
        own = [r[0] for r in pages.select("upload").distinct().limit(LISTED_UPLOADS + 1).collect()]
        if not own:
            return
        read = spark.read.schema(GATHERED_SCHEMA).option("basePath", gathered)
        if len(own) <= LISTED_UPLOADS:
            kept = read.parquet(*[f"{gathered}/upload={u}" for u in own])
        else:
            kept = read.parquet(gathered).join(pages.select("upload").distinct(), "upload", "left_semi")
        kept = kept.filter(F.col("batch_id") <= batch_id)
        touched = kept.select("academic_level", "upload_id").distinct()
        uploads = (kept.groupBy("academic_level", "upload_id")
                   .agg(F.count("*").alias("here"), F.max("upload_pages").alias("pages")))
        ready = (uploads.filter("here >= pages").groupBy("academic_level").agg(F.max("upload_id").alias("upload_id")))
        levels = (touched.select("academic_level").distinct().join(ready, "academic_level", "left")).persist()
        try:
            if levels.isEmpty():
                return
            _log_status(levels, status_path, batch_id, 0, "processing")
            complete = levels.filter("upload_id is not null")
            if complete.isEmpty():
                return
            try:
                newest = kept.join(complete, ["academic_level", "upload_id"], "left_semi")
                replace_level(chunks_of_pages(newest.select(*PAGE_SCHEMA.names), **chunk_options), chunks_path)
                if index_path:
                    names = [r[0] for r in complete.select("academic_level").dropna().collect()]
                    new = spark.read.schema(CHUNK_SCHEMA).parquet(chunks_path).filter(F.col("academic_level").isin(names))
                    index = SegmentedIndex(spark, index_path)
                    index.replace(searchable(new), rich_text(), emptied=tuple(names))
                    index.compact()
            except Exception as error:
                _log_status(complete, status_path, batch_id, 1, "failed", str(error))
                raise
            _log_status(complete, status_path, batch_id, 1, "completed")
            write_batch(uploads.filter("here >= pages").select(_upload_key().alias("upload")), f"{gathered}-done", batch_id)
        finally:
            levels.unpersist()

    return _run(pages, handle, checkpoint, "stream_ingest", available_now)


# --- questions --------------------------------------------------------------
def stream_labels(questions: DataFrame) -> DataFrame:
    """Every label that the question text alone decides; stateless, hence usable on any stream."""
    text = F.lower("text")
    labelled = questions.select(
        "*", *[c.alias(n) for n, c in academic_level(F.col("text"), open_ended=True).items()],
        detect_section(text).alias("section"), detect_entity(text).alias("entity"),
        detect_semester(text).alias("semester"), detect_year_level(text).alias("year_level"),
        detect_course(text).alias("course_code"), detect_person(text).alias("person_name"),
        detect_fee_type(text).alias("fee_type"), needs_rewrite(F.col("text")).alias("needs_rewrite"),
        is_identity_question(F.col("text")).alias("is_identity"))
    dim = F.broadcast(strategy_table(questions.sparkSession))
    return labelled.withColumn("strategy", strategy_name()).join(dim, "strategy")


def stream_route(questions: DataFrame, turns: DataFrame, prototypes: DataFrame, vocabulary: DataFrame, status: DataFrame,
                 path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Level, intent, seat route and rewrite flag of arriving questions, by the batch plan."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch, turns, prototypes, vocabulary, status)
        write_batch(routed.select("query_id", "intent", "seat_route", "is_pg", "is_ug", "needs_rewrite"), path, batch_id)

    return _run(questions, handle, checkpoint, "stream_route", available_now)


def stream_retrieve(questions: DataFrame, corpus: Corpus, path: str, checkpoint: str,
                    available_now: bool = False) -> StreamingQuery:
    """Contexts for arriving questions against corpus tables; top-k per question needs a batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(retrieve(batch, corpus), path, batch_id)

    return _run(questions, handle, checkpoint, "stream_retrieve", available_now)


# --- state ------------------------------------------------------------------
REUSE_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("query_id", T.LongType()),
                             T.StructField("answer", T.StringType()), T.StructField("hit", T.BooleanType())])


def _keep_for(state: GroupState, latest: pd.Timestamp | None, ttl_ms: int) -> None:
    """Let the state expire ``ttl_ms`` of event time after its latest row."""
    seen = int(latest.timestamp() * 1000) if latest is not None else 0
    state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + ttl_ms)


def _later(latest: pd.Timestamp | None, times: pd.Series) -> pd.Timestamp | None:
    newest = times.max() if len(times) else None
    return newest if latest is None or (newest is not None and newest > latest) else latest


def _order(ids: pd.Series) -> np.ndarray:
    """Numbers to sort by; a question without a number comes last."""
    return ids.to_numpy() if ids.dtype == np.int64 else ids.fillna(2 ** 62).astype("int64").to_numpy()


def stream_exact_reuse(questions: DataFrame, watermark: str = "1 hour", ttl_ms: int = 3_600_000) -> DataFrame:
    """(key, query_id, answer, hit): an answer seen for the same key before is given again.

    questions: key, query_id, ts, answer (of the generator, NULL if there is none yet). The state of a
    key is one answer, dropped ``ttl_ms`` of event time after its last question; a global cap could
    not be partitioned. Inside one micro-batch the order is that of query_id, over all its rows of a key; of
    those only the numbers are held, not the answers, and none once the key has an answer. Of repeated rows of the question
    that brings the answer, one is no hit.
    """
    def reuse(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        first, waiting, latest = None, [], None
        for rows in batches:
            latest = _later(latest, rows["ts"])
            if known is not None:
                yield pd.DataFrame({"key": key[0], "query_id": rows["query_id"], "answer": known, "hit": True})
                continue
            waiting.append(rows["query_id"])
            answers = rows["answer"].to_numpy()
            given = np.flatnonzero(pd.notna(answers))
            if len(given):
                order = _order(rows["query_id"])[given]
                at = int(order.argmin())
                found = (int(order[at]), answers[given[at]])
                first = found if first is None or found[0] < first[0] else first
        unused = True
        for ids in waiting:
            order = _order(ids)
            reached = order >= first[0] if first else np.zeros(len(order), dtype=bool)
            hits = reached.copy()
            own = np.flatnonzero(order == first[0]) if first and unused else []
            if len(own):
                hits[own[0]], unused = False, False
            yield pd.DataFrame({"key": key[0], "query_id": ids, "answer": np.where(reached, first[1] if first else None, None),
                                "hit": hits})
        known = first[1] if first else known
        if known is not None:
            state.update((known,))
            _keep_for(state, latest, ttl_ms)

    rows = questions.select("key", "query_id", "ts", "answer").withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(
        reuse, REUSE_SCHEMA, "answer string", "append", GroupStateTimeout.EventTimeTimeout)


HISTORY_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                               T.StructField("history", T.StringType()), T.StructField("n_turns", T.IntegerType()),
                               T.StructField("late", T.BooleanType())])


def stream_history(turns: DataFrame, n: int = fv.PROMPT_TURNS, watermark: str = "1 hour",
                   ttl_ms: int = 3_600_000) -> DataFrame:
    """(conv_id, turn, history, n_turns, late): the last ``n`` turns before each arriving turn.

    turns: conv_id, turn, role, text, ts. All turns of a conversation in a micro-batch are put in order
    before they are read. The state is its last ``n`` turns, dropped ``ttl_ms`` of event time after the
    last one. A turn that is not above those of earlier batches comes out as ``late``, without a history,
    and changes no state; only turns older than the watermark are dropped, by Spark.
    """
    def remember(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers, lines = (list(x) for x in state.get) if state.exists else ([], [])
        latest, rows = None, []
        for batch in batches:
            latest = _later(latest, batch["ts"])
            # plain lists: most conversations have few turns, and a frame costs more than they do
            rows += zip(batch["turn"].tolist(), batch["role"].tolist(), batch["text"].tolist())
        rows.sort(key=lambda r: r[0])
        said, histories, counts, late = [], [], [], []
        for turn, role, text in rows:
            behind = bool(numbers) and turn <= numbers[-1]
            said.append(int(turn))
            histories.append(None if behind else "\n".join(lines))
            counts.append(None if behind else len(lines))
            late.append(behind)
            if not behind:
                numbers = (numbers + [int(turn)])[-n:]
                lines = (lines + [f"{'User' if role == 'user' else 'Assistant'}: {text}"])[-n:]
        yield pd.DataFrame({"conv_id": [key[0]] * len(said), "turn": said, "history": histories,
                            "n_turns": pd.array(counts, dtype="Int32"), "late": late})
        state.update((numbers, lines))
        _keep_for(state, latest, ttl_ms)

    rows = turns.select("conv_id", "turn", "role", "text", "ts").withWatermark("ts", watermark)
    return rows.groupBy("conv_id").applyInPandasWithState(
        remember, HISTORY_SCHEMA, "numbers array<bigint>, lines array<string>", "append",
        GroupStateTimeout.EventTimeTimeout)


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Process everything that is available and write it as parquet; start again to go on."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).outputMode("append").trigger(availableNow=True).start()
