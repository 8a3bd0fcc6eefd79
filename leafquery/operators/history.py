"""Conversation operators on turns(conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from .ranking import top_k
from .understand import lookback, truncated

MESSAGE = "struct<role:string,content:string>"

GENERAL_PROMPT = (
    "You answer general questions about the university in a friendly way. Do not state admission rules, fees, "
    "curricula, staff or seat numbers from memory.")
CONTEXT_PROMPT = (
    "You answer questions about the university from the context below and from nothing else. Copy names and "
    "numbers exactly, cite the source of each statement, keep undergraduate and postgraduate facts apart, show "
    "tables as tables, and say what the context does not tell.\n\nContext:\n")
SEAT_PROMPT = "\n\nAnswer about seats only and leave out every kind of fee."


def truncate_assistant(turns: DataFrame, n: int = fv.ASSISTANT_CHARS) -> DataFrame:
    return turns.withColumn("text", truncated(F.col("role"), F.col("text"), n))


def last_turns(turns: DataFrame, n: int, key: str = "conv_id") -> DataFrame:
    """Last ``n`` turns per conversation; groups are cut to n rows before they are shuffled."""
    return top_k(turns, [key], [F.col("turn").desc()], n, rank_col="back")


def speaker_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "User: ").otherwise("Assistant: "), text)


def render_transcript(turns: DataFrame, n: int = fv.REWRITE_TURNS, key: str = "conv_id") -> DataFrame:
    """(conv_id, transcript) of the last ``n`` turns, assistant texts shortened."""
    recent = truncate_assistant(last_turns(turns, n, key))
    return (recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select(key, F.array_join(F.transform("_t", lambda t: speaker_line(t["role"], t["text"])), "\n")
                    .alias("transcript")))


def rewrite_input(queries: DataFrame, turns: DataFrame, n: int = fv.REWRITE_TURNS) -> DataFrame:
    """(query_id, transcript) of the turns before each question; empty without history."""
    back = lookback(queries, turns, n)
    lines = back.select("query_id", "back", speaker_line(
        F.col("role"), truncated(F.col("role"), F.col("text"))).alias("line"))
    told = (lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("back", "line")), asc=False).alias("_l"))
            .select("query_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("transcript")))
    return queries.select("query_id").join(told, "query_id", "left").withColumn(
        "transcript", F.coalesce("transcript", F.lit("")))


def history_key(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, history): ``role:content`` of all turns joined by a pipe.

    The row is as long as the conversation. For reuse tables prefer ``history_digest``,
    whose state has a fixed size.
    """
    return (turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select(key, F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "|")
                    .alias("history")))


def history_digest(queries: DataFrame, turns: DataFrame, segment_turns: int = 4096) -> DataFrame:
    """(query_id, history): equal for two questions iff the turns before them are equal.

    A fingerprint of fixed size (count and two 64-bit hashes over position, role and text)
    runs along the turns of a (conversation, segment); between segments one row each is
    passed on. A question looks its value up by (conv_id, turn - 1), so no conversation is
    ever collected, however long it is.
    """
    marks = ("_n", "_a", "_b")
    shown = truncated(F.col("role"), F.col("text"))
    marked = turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / F.lit(segment_turns)).alias("_seg"), F.lit(1).alias("_n"),
        F.xxhash64("turn", "role", shown).alias("_a"), F.xxhash64(F.lit("second"), "turn", "role", shown).alias("_b"))

    def merge(name: str) -> Column:
        return F.sum(name) if name == "_n" else F.bit_xor(name)

    whole = marked.groupBy("conv_id", "_seg").agg(*[merge(m).alias(m) for m in marks])
    before = Window.partitionBy("conv_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    incoming = whole.select("conv_id", "_seg", *[merge(m).over(before).alias(f"_in{m}") for m in marks])
    here = Window.partitionBy("conv_id", "_seg").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.select("conv_id", "_seg", "turn", *[merge(m).over(here).alias(m) for m in marks]) \
        .join(incoming, ["conv_id", "_seg"], "left")
    zero = F.lit(0).cast("long")
    digest = F.concat_ws(":", (F.col("_n") + F.coalesce("_in_n", zero)).cast("string"), *[
        F.col(m).bitwiseXOR(F.coalesce(f"_in{m}", zero)).cast("string") for m in ("_a", "_b")])
    known = running.select("conv_id", (F.col("turn") + 1).alias("turn"), digest.alias("history"))
    return (queries.select("query_id", "conv_id", "turn").join(known, ["conv_id", "turn"], "left")
            .select("query_id", F.coalesce("history", F.lit("")).alias("history")))


def system_prompt(intent: Column, context: Column, is_seat: Column) -> Column:
    text = F.concat(F.lit(CONTEXT_PROMPT), F.coalesce(context, F.lit("")))
    text = F.when(is_seat, F.concat(text, F.lit(SEAT_PROMPT))).otherwise(text)
    return F.when(intent == "GENERAL", GENERAL_PROMPT).otherwise(text)


def assemble_messages(queries: DataFrame, turns: DataFrame, n: int = fv.PROMPT_TURNS) -> DataFrame:
    """(query_id, messages): system text, the last ``n`` turns, then the standalone question.

    ``queries``: query_id, conv_id, turn, text, intent, context and optionally is_seat.
    """
    is_seat = F.coalesce("is_seat", F.lit(False)) if "is_seat" in queries.columns else F.lit(False)
    recent = lookback(queries, turns, n).select("query_id", "back", F.struct(
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"),
        truncated(F.col("role"), F.col("text")).alias("content")).alias("_m"))
    past = recent.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("back", "_m")), asc=False).alias("_h"))
    first = F.array(F.struct(F.lit("system").alias("role"), system_prompt(
        F.col("intent"), F.col("context"), is_seat).alias("content")))
    last = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    middle = F.coalesce(F.transform("_h", lambda x: x["_m"]), F.array().cast(f"array<{MESSAGE}>"))
    return queries.join(past, "query_id", "left").select("query_id", F.concat(first, middle, last).alias("messages"))
