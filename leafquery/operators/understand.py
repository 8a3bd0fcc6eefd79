"""Question understanding: one row per question in, labelled columns out."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.staging import small_side, stage
from ..functions.text import (SPACE, any_of, first_group, first_match, java_regex, matches, matches_any, strip,
                              words)
from .dense import max_similarity

#: lengths of alias prefixes that questions and aliases are joined on
ANCHOR_LENGTHS = (16, 8, 3, 2, 1)
#: aliases that may be broadcast
BROADCAST_ALIASES = 100_000
_NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


# --- level ------------------------------------------------------------------
def _patterns(patterns: list[str], loose_degrees: bool) -> list[str]:
    return [p.removesuffix(r"\b") if loose_degrees and p.endswith(r"\.\b") else p for p in patterns]


def academic_level(text: Column, open_ended: bool = False, loose_degrees: bool = False) -> dict[str, Column]:
    pg, ug = (fv.PG_PATTERNS_OPEN, fv.UG_PATTERNS_OPEN) if open_ended else (fv.PG_PATTERNS, fv.UG_PATTERNS)
    low = F.lower(text)
    return {"is_pg": matches_any(low, _patterns(pg, loose_degrees)),
            "is_ug": matches_any(low, _patterns(ug, loose_degrees))}


def truncated(role: Column, text: Column, n: int = fv.ASSISTANT_CHARS) -> Column:
    return F.when((role == "assistant") & (F.length(text) > n),
                  F.concat(F.substring(text, 1, n), F.lit(fv.TRUNCATION_MARK))).otherwise(text)


def lookback(queries: DataFrame, turns: DataFrame, n: int) -> DataFrame:
    """(query_id, back, role, text) of the ``n`` turns before each question, back = 1 for the newest.

    ``turn`` is the position in the conversation, so the turns wanted are known by
    their key: an equi-join on (conv_id, turn), never a pairing of all turns of a conversation.
    """
    wanted = queries.select("query_id", "conv_id", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("turn") - i)).alias("_pos", "turn"))
    return (wanted.join(turns.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"])
            .select("query_id", (F.col("_pos") + 1).alias("back"), "role", "text"))


def level_from_history(queries: DataFrame, turns: DataFrame, n: int = fv.LOOKBACK_TURNS,
                       open_ended: bool = True, loose_degrees: bool = False) -> DataFrame:
    """(query_id, is_pg, is_ug): from the question itself, else from the newest turn that tells."""
    own = queries.select("query_id", "conv_id", "turn", *[
        c.alias(k) for k, c in academic_level(F.col("text"), open_ended, loose_degrees).items()])
    open_q = own.filter(~F.col("is_pg") & ~F.col("is_ug"))
    back = lookback(open_q, turns, n)
    level = academic_level(truncated(F.col("role"), F.col("text")), open_ended, loose_degrees)
    hits = back.select("query_id", "back", F.when(level["is_pg"], "pg").when(level["is_ug"], "ug").alias("_hit"))
    found = (hits.filter(F.col("_hit").isNotNull()).groupBy("query_id")
             .agg(F.min_by("_hit", "back").alias("_hit")))
    return own.join(found, "query_id", "left").select(
        "query_id", (F.col("is_pg") | (F.coalesce("_hit", F.lit("")) == "pg")).alias("is_pg"),
        (F.col("is_ug") | (F.coalesce("_hit", F.lit("")) == "ug")).alias("is_ug"))


def seat_levels(queries: DataFrame, turns: DataFrame, n: int = fv.LOOKBACK_TURNS) -> DataFrame:
    """Seat variant: question and last turns read as one text."""
    history = (lookback(queries, turns, n).groupBy("query_id")
               .agg(F.array_sort(F.collect_list(F.struct("back", truncated(F.col("role"), F.col("text")).alias("text")))).alias("_h")))
    text = F.concat_ws(" ", F.col("text"), F.array_join(F.transform("_h", lambda s: s["text"]), " "))
    return queries.join(history, "query_id", "left").select(
        "query_id", *[c.alias(k) for k, c in academic_level(text).items()])


# --- names ------------------------------------------------------------------
def _grams(text: Column, n: int) -> Column:
    """All distinct substrings of length n, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _keyed_grams(text: Column, n: int) -> Column:
    return F.transform(_grams(text, n), lambda g: F.struct(F.lit(n).alias("_n"), g.alias("_gram")))


def detect_names(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, department, faculty, program, designation) whose alias is a substring of the question.

    An alias can only occur where its first, middle and last characters occur, so questions and
    aliases meet in an equi-join on that of the three which the fewest aliases have ("department
    of" begins many, but ends none), and only those pairs are tested. Longest alias wins, then the
    first in alphabetical order. Aliases of checked number are broadcast. The substrings of the questions
    never are: the planner takes them for no larger than the file they come from.
    """
    low = queries.select("query_id", F.lower("text").alias("_q"))
    size = F.length("alias")
    anchor_len = functools.reduce(lambda case, n: case.when(size >= n, n), ANCHOR_LENGTHS[1:],
                                  F.when(size >= ANCHOR_LENGTHS[0], ANCHOR_LENGTHS[0]))
    n = F.col("_n")
    anchors = [F.substring(F.col("alias"), at, n) for at in (
        F.lit(1), F.floor((size - n) / 2).cast("int") + 1, size - n + 1)]
    marked = (aliases.filter(size > 0).withColumn("_n", anchor_len)
              .select("*", F.explode(F.array_distinct(F.array(*anchors))).alias("_gram")))
    shared = marked.groupBy("_n", "_gram").agg(F.count(F.lit(1)).alias("_c"))
    keyed = (marked.join(shared, ["_n", "_gram"]).groupBy("kind", "name", "alias", "_n")
             .agg(F.min(F.struct("_c", "_gram")).alias("_a")).select("kind", "name", "alias", "_n", "_a._gram"))
    grams = F.flatten(F.array(*[_keyed_grams(F.col("_q"), n) for n in ANCHOR_LENGTHS]))
    asked = low.select("query_id", F.explode(grams).alias("_g")).select("query_id", "_g._n", "_g._gram").hint("merge")
    candidates = asked.join(small_side(stage(keyed), BROADCAST_ALIASES), ["_n", "_gram"]).select("query_id", "kind", "name", "alias")
    found = candidates.join(low, "query_id").filter(F.contains("_q", F.col("alias")))

    def best(kind: str) -> Column:
        # shortest negative length first = longest alias, then alphabetical
        order = F.struct((-size).alias("l"), F.col("alias"), F.col("name"))
        return F.min_by("name", F.when(F.col("kind") == kind, order)).alias(kind)

    return found.groupBy("query_id").agg(*[best(k) for k in ("department", "faculty", "program", "designation")])


# --- scalar labels ----------------------------------------------------------
def detect_section(text: Column) -> Column:
    return first_group(F.lower(text), fv.QUESTION_SECTIONS)


def detect_entity(text: Column) -> Column:
    return first_group(F.lower(text), fv.QUESTION_ENTITIES)


def detect_semester(text: Column) -> Column:
    hit = F.coalesce(first_match(text, fv.QUESTION_SEMESTER_PATTERN, 1),
                     first_match(text, fv.QUESTION_SEMESTER_PATTERN, 2)).try_cast("int")
    case = F.when(matches(text, fv.QUESTION_SEMESTER_PATTERN), hit)
    for word, number in fv.NUMBER_WORDS.items():
        case = case.when(matches(text, rf"(?i)(?:\b{word}\s+semester\b|\bsemester\s+{word}\b)"), number)
    # every pattern holds this word; few questions do
    return F.when(F.contains(F.lower(text), F.lit("semester")), case)


def detect_year_level(text: Column) -> Column:
    return F.lower(first_match(text, fv.YEAR_PATTERN, 1))


def detect_course(text: Column) -> Column:
    return first_match(text, fv.QUESTION_COURSE_PATTERN)


def detect_person(text: Column) -> Column:
    return strip(first_match(text, fv.PERSON_PATTERN))


def detect_fee_type(text: Column) -> Column:
    return first_group(F.lower(text), {w: [w] for w in fv.FEE_TYPES})


def build_filters(align_sections: bool = True) -> dict[str, Column]:
    """Typed nullable filter columns; NULL means no filter on that field.

    Stored sections are singular after ``align_sections`` (see ``bm25.searchable``).
    """
    section = F.when(F.col("fee_type").isNotNull(), "fees").when(
        F.coalesce(F.col("section") != "admission", F.lit(False)), F.col("section"))
    return {"f_department": F.col("department"), "f_section": section, "f_faculty": F.col("faculty"),
            "f_course_code": F.upper("course_code") if align_sections else F.col("course_code")}


def understand(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add every question metadata column and its filters.

    The pattern work runs where the questions lie, before they are shuffled to meet their names.
    """
    text = F.lower("text")
    labelled = queries.select(
        "*", detect_section(text).alias("_section"), detect_entity(text).alias("_entity"),
        detect_semester(text).alias("semester"), detect_year_level(text).alias("year_level"),
        detect_course(text).alias("course_code"), detect_person(text).alias("person_name"),
        detect_fee_type(text).alias("fee_type"))
    named = labelled.join(detect_names(queries, aliases), "query_id", "left").select(
        *queries.columns, "department", "faculty", "program",
        F.when(F.col("designation").isNotNull(), "faculty").otherwise(F.col("_section")).alias("section"),
        F.coalesce("_entity", "designation").alias("entity"),
        "semester", "year_level", "course_code", "person_name", "fee_type")
    return named.select("*", *[c.alias(k) for k, c in build_filters().items()])


def strategy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.STRATEGIES, (
        "strategy string, dense_k int, sparse_k int, rerank_k int, expand_section boolean, "
        "expand_page boolean, expand_table boolean, use_filter boolean"))


def strategy_name() -> Column:
    by_section = [name for name, *_ in fv.STRATEGIES[:7]]
    return (F.when(F.col("section").isin(*by_section), F.col("section"))
            .when(F.col("person_name").isNotNull(), "person")
            .when(F.col("course_code").isNotNull(), "course")
            .when(F.col("semester").isNotNull() | F.col("year_level").isNotNull(), "semester_or_year")
            .otherwise("default"))


def choose_strategy(understood: DataFrame) -> DataFrame:
    """Add the strategy columns; the right side is the constant 11-row table."""
    dim = F.broadcast(strategy_table(understood.sparkSession))
    return understood.withColumn("strategy", strategy_name()).join(dim, "strategy")


# --- intent -----------------------------------------------------------------
def seat_keyword_score(text: Column) -> Column:
    low = F.lower(text)
    hits = functools.reduce(lambda a, b: a + b, [
        F.contains(low, F.lit(w)).cast("int") for w in fv.SEAT_KEYWORDS])
    return F.least(hits / F.lit(2.0), F.lit(1.0))


def seat_regex_score(text: Column) -> Column:
    return matches_any(F.lower(text), fv.SEAT_PATTERNS).cast("int")


def prototype_score(queries: DataFrame, prototypes: DataFrame, classes: tuple[str, ...] = ("seat", "general"),
                    **limits) -> DataFrame:
    """(query_id, <class>_sim ...): best cosine of each question to the prototypes of each class."""
    return max_similarity(queries, prototypes, classes, **limits)


def intent_words(text: Column) -> Column:
    """Distinct words after dropping everything but word characters and spaces."""
    cleaned = F.regexp_replace(strip(F.lower(text)), _NOT_WORD_OR_SPACE, "")
    return F.array_distinct(F.filter(F.split(cleaned, SPACE + "+"), lambda w: w != ""))


def classify_intent(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``intent``. ``queries`` carries seat_sim and general_sim; NULL scores (an error) read as RAG.

    The vocabulary may be large, so questions meet it by an equi-join on their words.
    """
    text = F.col("text")
    tokens = intent_words(text)
    known = (queries.select("query_id", F.explode(tokens).alias("word")).join(vocabulary.select("word"), "word", "left_semi")
             .select("query_id").distinct().withColumn("_known", F.lit(True)))
    wk, wr, ws = fv.SEAT_WEIGHTS
    final_seat = (seat_keyword_score(text) * wk + seat_regex_score(text) * wr) + F.col("seat_sim") * ws

    def has(words_: list[str]) -> Column:
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words_]))

    intent = (F.when(has(fv.SEAT_STRONG_WORDS), "SEAT")
              .when(has(fv.RAG_WORDS) | F.coalesce("_known", F.lit(False)), "RAG")
              .when(F.round(final_seat, 6) > fv.SEAT_THRESHOLD, "SEAT")
              .when(F.round("general_sim", 6) > fv.GENERAL_THRESHOLD, "GENERAL")
              .otherwise("RAG"))
    return queries.join(known, "query_id", "left").withColumn("intent", intent).drop("_known")


def route_seat(queries: DataFrame, status: DataFrame) -> DataFrame:
    """Add ``seat_route`` (PG_POLICY, UG_LINK, BOTH or NULL) and the final ``intent``.

    ``queries`` carries intent, use_pg and the seat variant of is_pg / is_ug.
    The two facts about stored pages are scalar subqueries over the status table.
    """
    def stored(level: str) -> Column:
        has = F.coalesce(F.max(F.when(F.col("academic_level") == level, F.size("excluded_pages") > 0)), F.lit(False))
        return status.agg(has.alias("stored")).scalar()

    ug_pages, pg_pages = stored(fv.UNDERGRADUATE), stored(fv.POSTGRADUATE)
    pg, ug = F.col("is_pg") & F.col("use_pg"), F.col("is_ug")
    fallback = ((ug & ~pg & ~ug_pages) | (pg & ~ug & ~pg_pages) | (~ug & ~pg & ~ug_pages & ~pg_pages))
    route = F.when((F.col("intent") == "SEAT") & ~fallback,
                   F.when(pg & ~ug, "PG_POLICY").when(ug & ~pg, "UG_LINK").otherwise("BOTH"))
    out = queries.withColumn("seat_route", route)
    return out.withColumn("intent", F.when((F.col("intent") == "SEAT") & F.col("seat_route").isNull(), "RAG")
                          .otherwise(F.col("intent")))


# --- rewriting --------------------------------------------------------------
def needs_rewrite(text: Column) -> Column:
    low = strip(F.lower(text))
    tokens = words(low)

    def overlap(list_: list[str]) -> Column:
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in list_]))

    n = F.size(tokens)
    short = n <= 3
    return (n > 0) & (
        overlap(fv.CONTEXTUAL_WORDS)
        | ((n == 1) & overlap(fv.CONTINUATION_WORDS))
        | any_of([F.startswith(low, F.lit(p)) for p in fv.FOLLOWUP_PREFIXES])
        | (F.endswith(low, F.lit("?")) & short)
        | (short & overlap(fv.CONTINUATION_WORDS)))


def is_identity_question(text: Column) -> Column:
    return any_of([matches(F.lower(text), p) for p in fv.IDENTITY_PATTERNS])


def clean_rewrite(rewritten: Column, original: Column, strip_only: bool = False) -> Column:
    out = strip(rewritten)
    if not strip_only:
        out = F.regexp_replace(F.regexp_replace(out, "[\"']", ""), java_regex(fv.REWRITE_PREFIX_PATTERN), "")
    return F.coalesce(F.nullif(out, F.lit("")), original)
