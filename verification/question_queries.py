"""Question understanding, conversation history and intent."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafquery.functions import fixed_values as fv
from leafquery.operators import history as H, understand as U, vocab as K

from leafquery.plans.answer import rewritten_questions

from .fixtures import CHUNKS_SQL, QUESTIONS_SQL, chunks, questions, shown, shown_sql, table, turns
from leafquery.functions.text import expand_abbreviations, tokenize
from .ingest_queries import SQL as INGEST_SQL, TRIM
from .patterns import AFTER as E, BEFORE as B, WORD as N, any_of, bounded, contains_any, first_name, values

QUERIES, SQL = {}, {}
QS = f"with q as {QUESTIONS_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def scalar(name: str, sql_cols: dict[str, str], spark_cols):
    """A query of one row per question with scalar labels."""
    sql = f"{QS} select query_id, " + ", ".join(shown_sql(e, n) for n, e in sql_cols.items()) + " from q"
    query(name, sql)(lambda spark, sf: questions(spark, sf).select("query_id", *[
        shown(c, n) for n, c in spark_cols().items()]))


SYNONYM_CASES = " ".join(f"when '{a}' then '{b}'" for a, b in fv.SYNONYMS.items())


def tokens_sql(text: str) -> str:
    return (f"list_transform(regexp_extract_all(lower({text}), '{N}+'), lambda t: case t {SYNONYM_CASES} else t end)")


@query("tokenize", f"""select doc_id, len(ts) as n_tokens, md5(array_to_string(ts, ' ')) as md5 from
 (select doc_id, {tokens_sql('text')} as ts from documents)""")
def _(spark, sf):
    ts = tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"),
                                                F.md5(F.array_join(ts, " ")).alias("md5"))


scalar("expand_abbreviations",
       {"expanded": f"md5(regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}_])(?i:phd)($|[^\\p{{L}}\\p{{N}}_])', '\\1doctor of philosophy\\2', 'g'))"},
       lambda: {"expanded": F.md5(expand_abbreviations(F.col("text"), {"phd": "doctor of philosophy"}))})

PG, UG = any_of(fv.PG_PATTERNS), any_of(fv.UG_PATTERNS)
PG_OPEN, UG_OPEN = any_of(fv.PG_PATTERNS_OPEN), any_of(fv.UG_PATTERNS_OPEN)

scalar("academic_level", {"is_pg": f"regexp_matches(lower(text), '{PG}')", "is_ug": f"regexp_matches(lower(text), '{UG}')"},
       lambda: U.academic_level(F.col("text")))

TRUNC = (f"case when role = 'assistant' and length(text) > {fv.ASSISTANT_CHARS} then "
         f"concat(substr(text, 1, {fv.ASSISTANT_CHARS}), '{fv.TRUNCATION_MARK}') else text end")

HISTORY_SQL = f"""{QS}, t as (select q.query_id, q.turn - c.turn as back, c.role, c.text from q join conversations c
  on c.conv_id = q.conv_id and c.turn < q.turn and c.turn >= q.turn - """


@query("level_from_history", HISTORY_SQL + f"""4), l as (select query_id, back, case when regexp_matches(lower({TRUNC}), '{PG_OPEN}') then 'pg'
  when regexp_matches(lower({TRUNC}), '{UG_OPEN}') then 'ug' end as hit from t),
 f as (select query_id, arg_min(hit, back) filter (where hit is not null) as hit from l group by 1),
 o as (select query_id, regexp_matches(lower(text), '{PG_OPEN}') as pg, regexp_matches(lower(text), '{UG_OPEN}') as ug from q)
 select query_id, pg or (not pg and not ug and coalesce(hit, '') = 'pg') as is_pg,
  ug or (not pg and not ug and coalesce(hit, '') = 'ug') as is_ug from o left join f using (query_id)""")
def _(spark, sf):
    return U.level_from_history(questions(spark, sf), turns(spark, sf))


@query("seat_levels", HISTORY_SQL + f"""4), h as (select query_id, string_agg({TRUNC}, ' ' order by back) as past from t group by 1)
 select query_id, regexp_matches(lower(concat_ws(' ', text, past)), '{PG}') as is_pg,
  regexp_matches(lower(concat_ws(' ', text, past)), '{UG}') as is_ug from q left join h using (query_id)""")
def _(spark, sf):
    return U.seat_levels(questions(spark, sf), turns(spark, sf))


ALIASES_SQL = " union ".join([
    *[f"select '{k}' as kind, name, alias from ({INGEST_SQL[k + '_aliases']})" for k in ("department", "faculty", "program")],
    f"select 'department', trim(department), lower(trim(department)) from {CHUNKS_SQL} where department is not null",
    f"select 'designation', term, term from ({INGEST_SQL['designation_terms']})"])
NAMES_SQL = f"""al as ({ALIASES_SQL}),
 m as (select query_id, kind, name, row_number() over (partition by query_id, kind order by length(alias) desc, alias, name) as rn
  from q join al on contains(lower(q.text), al.alias)),
 nm as (select query_id, {", ".join(f"max(case when kind = '{k}' then name end) as {k}" for k in ("department", "faculty", "program", "designation"))}
  from m where rn = 1 group by query_id)"""


@query("detect_names", f"""{QS}, {NAMES_SQL} select query_id, {", ".join(shown_sql(k, k) for k in ("department", "faculty", "program", "designation"))} from nm""")
def _(spark, sf):
    found = U.detect_names(questions(spark, sf), K.all_aliases(chunks(spark, sf)))
    return found.select("query_id", *[shown(k, k) for k in ("department", "faculty", "program", "designation")])


SECTION_SQL = first_name("lower(text)", fv.QUESTION_SECTIONS)
ENTITY_SQL = first_name("lower(text)", fv.QUESTION_ENTITIES)
_SEM = fv.QUESTION_SEMESTER_PATTERN
SEMESTER_SQL = (f"case when regexp_matches(text, '{_SEM}') then cast(coalesce(nullif(regexp_extract(text, '{_SEM}', 1), ''), regexp_extract(text, '{_SEM}', 2)) as int) "
                + " ".join(f"when regexp_matches(lower(text), '{B}{w}\\s+semester{E}|{B}semester\\s+{w}{E}') then {n}" for w, n in fv.NUMBER_WORDS.items()) + " end")
YEAR_SQL = f"nullif(lower(regexp_extract(text, '{bounded(fv.YEAR_PATTERN)}', 1)), '')"
COURSE_SQL = f"nullif(regexp_extract(lower(text), '{bounded(fv.QUESTION_COURSE_PATTERN, capture=True)}', 1), '')"
PERSON_SQL = f"nullif(trim(regexp_extract(lower(text), '{fv.PERSON_PATTERN}', 0), {TRIM}), '')"
FEE_SQL = first_name("lower(text)", {w: [w] for w in fv.FEE_TYPES})

scalar("detect_section", {"section": SECTION_SQL}, lambda: {"section": U.detect_section(F.col("text"))})
scalar("detect_entity", {"entity": ENTITY_SQL}, lambda: {"entity": U.detect_entity(F.col("text"))})
scalar("detect_semester", {"semester": SEMESTER_SQL}, lambda: {"semester": U.detect_semester(F.col("text"))})
scalar("detect_year_level", {"year_level": YEAR_SQL}, lambda: {"year_level": U.detect_year_level(F.col("text"))})
scalar("detect_course_person_fee", {"course_code": COURSE_SQL, "person_name": PERSON_SQL, "fee_type": FEE_SQL},
       lambda: {"course_code": U.detect_course(F.lower("text")), "person_name": U.detect_person(F.lower("text")),
                "fee_type": U.detect_fee_type(F.col("text"))})

UNDERSTOOD_SQL = f"""{NAMES_SQL}, un as (select q.*, department, faculty, program,
  case when designation is not null then 'faculty' else {SECTION_SQL} end as section, coalesce({ENTITY_SQL}, designation) as entity,
  {SEMESTER_SQL} as semester, {YEAR_SQL} as year_level, {COURSE_SQL} as course_code, {PERSON_SQL} as person_name, {FEE_SQL} as fee_type
  from q left join nm using (query_id)),
 uf as (select *, department as f_department, case when fee_type is not null then 'fees' when section <> 'admission' then section end as f_section,
  faculty as f_faculty, upper(course_code) as f_course_code from un)"""
FILTERS = ("f_department", "f_section", "f_faculty", "f_course_code")


@query("build_filters", f"{QS}, {UNDERSTOOD_SQL} select query_id, " + ", ".join(shown_sql(f, f) for f in FILTERS) + " from uf")
def _(spark, sf):
    u = U.understand(questions(spark, sf), K.all_aliases(chunks(spark, sf)))
    return u.select("query_id", *[shown(f, f) for f in FILTERS])


STRATEGY_SQL = f"""st(strategy, dense_k, sparse_k, rerank_k, es, ep, et, uf) as (values {values(fv.STRATEGIES)}),
 sg as (select uf.*, st.* from uf join st on st.strategy = case when section is not null then section when person_name is not null then 'person'
  when course_code is not null then 'course' when semester is not null or year_level is not null then 'semester_or_year' else 'default' end)"""


@query("choose_strategy", f"{QS}, {UNDERSTOOD_SQL}, {STRATEGY_SQL} select query_id, strategy, dense_k, sparse_k, rerank_k, es, ep, et, uf from sg")
def _(spark, sf):
    s = U.choose_strategy(U.understand(questions(spark, sf), K.all_aliases(chunks(spark, sf))))
    return s.select("query_id", "strategy", "dense_k", "sparse_k", "rerank_k", F.col("expand_section").alias("es"),
                    F.col("expand_page").alias("ep"), F.col("expand_table").alias("et"), F.col("use_filter").alias("uf"))


KEYWORD_SQL = "least((" + " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in fv.SEAT_KEYWORDS) + ") / 2.0, 1.0)"
SEAT_RE = "|".join(fv.SEAT_PATTERNS)
scalar("seat_keyword_score", {"score": f"cast({KEYWORD_SQL} as double)"}, lambda: {"score": U.seat_keyword_score(F.col("text"))})
scalar("seat_regex_score", {"score": f"cast(regexp_matches(lower(text), '{SEAT_RE}') as int)"},
       lambda: {"score": U.seat_regex_score(F.col("text"))})


def with_vectors(spark, sf, df):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vec"))
    return df.join(vec, "conv_id")


def prototypes(spark, sf):
    name = F.when(F.col("label") == 0, "seat").when(F.col("label") == 1, "general")
    return table(spark, sf, "embeddings").select(name.alias("class"), F.col("embedding").alias("vec")).filter("class is not null")


_DBL = "list_transform({}, lambda x: cast(x as double))"


def cosine_sql(a, b):
    x, y = _DBL.format(a), _DBL.format(b)
    return f"list_dot_product({x}, {y}) / sqrt(list_dot_product({x}, {x})) / sqrt(list_dot_product({y}, {y}))"


SIM_SQL = f"""pv as (select conv_id, p.label, max({cosine_sql('e.embedding', 'p.embedding')}) as s from (select distinct conv_id from q) c
  join embeddings e on e.vec_id = c.conv_id cross join (select label, embedding from embeddings where label in (0, 1)) p group by 1, 2),
 sims as (select query_id, max(case when label = 0 then s end) as seat_sim, max(case when label = 1 then s end) as general_sim
  from q join pv using (conv_id) group by 1)"""


@query("prototype_score", f"{QS}, {SIM_SQL} select query_id, round(seat_sim, 6) as seat_sim, round(general_sim, 6) as general_sim from sims")
def _(spark, sf):
    s = U.prototype_score(with_vectors(spark, sf, questions(spark, sf)), prototypes(spark, sf))
    return s.select("query_id", F.round("seat_sim", 6).alias("seat_sim"), F.round("general_sim", 6).alias("general_sim"))


INTENT_SQL = f"""{SIM_SQL}, vo as ({INGEST_SQL['keyword_vocab'].replace(' union select lang from documents', '')}),
 ws as (select query_id, list_distinct(string_split_regex(regexp_replace(trim(lower(text), {TRIM}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+')) as w from q),
 kn as (select distinct query_id from (select query_id, unnest(w) as word from ws) join vo using (word)),
 it as (select q.*, case when list_has_any(w, {fv.SEAT_STRONG_WORDS}) then 'SEAT' when list_has_any(w, {fv.RAG_WORDS}) or kn.query_id is not null then 'RAG'
  when round({KEYWORD_SQL} * 0.25 + cast(regexp_matches(lower(text), '{SEAT_RE}') as int) * 0.25 + seat_sim * 0.5, 6) > 0.72 then 'SEAT'
  when round(general_sim, 6) > 0.82 then 'GENERAL' else 'RAG' end as intent
  from q join ws using (query_id) left join sims using (query_id) left join kn using (query_id))"""


def intents(spark, sf):
    q = questions(spark, sf)
    scored = q.join(U.prototype_score(with_vectors(spark, sf, q), prototypes(spark, sf)), "query_id", "left")
    return U.classify_intent(scored, K.keyword_vocab(chunks(spark, sf)))


@query("classify_intent", f"{QS}, {INTENT_SQL} select query_id, intent from it")
def _(spark, sf):
    return intents(spark, sf).select("query_id", "intent")


def status(spark, sf):
    """Undergraduate has stored pages, postgraduate none; both rows come from the data."""
    level = F.when(F.col("lang") == "en", "undergraduate").otherwise("postgraduate")
    pages_ = F.collect_set(F.when(level == "undergraduate", (F.col("doc_id") % 90).cast("int")))
    return (table(spark, sf, "documents").groupBy(level.alias("academic_level"))
            .agg(pages_.alias("excluded_pages"))
            .select("academic_level", "excluded_pages", F.lit("completed").alias("ingestion_status"),
                    F.lit(None).cast("string").alias("ingestion_error")))


@query("route_seat", f"""{QS}, {INTENT_SQL}, lv as ({SQL['seat_levels'].replace(QS + ',', 'with', 1)}),
 z as (select query_id, intent, is_pg and query_id % 2 = 0 as pg, is_ug as ug from it join lv using (query_id))
 select query_id, case when intent <> 'SEAT' then intent when pg and not ug then 'RAG' else 'SEAT' end as intent,
  case when intent <> 'SEAT' or (pg and not ug) then 'NULL' when ug and not pg then 'UG_LINK' else 'BOTH' end as seat_route from z""".replace(
      "with t as (select q.query_id", "with t as (select q.query_id"))
def _(spark, sf):
    q = intents(spark, sf).join(U.seat_levels(questions(spark, sf), turns(spark, sf)), "query_id")
    q = q.withColumn("use_pg", F.col("query_id") % 2 == 0)
    return U.route_seat(q, status(spark, sf)).select("query_id", "intent", shown("seat_route", "seat_route"))


_WORDS = f"regexp_extract_all(lower(text), '{N}+')"
REWRITE_SQL = f"""len({_WORDS}) > 0 and (list_has_any({_WORDS}, {fv.CONTEXTUAL_WORDS}) or (len({_WORDS}) <= 3 and list_has_any({_WORDS}, {fv.CONTINUATION_WORDS}))
 or regexp_matches(trim(lower(text), {TRIM}), '^({"|".join(fv.FOLLOWUP_PREFIXES)})')
 or (len({_WORDS}) <= 3 and regexp_matches(trim(lower(text), {TRIM}), '\\?$')))"""
scalar("needs_rewrite", {"needs_rewrite": REWRITE_SQL}, lambda: {"needs_rewrite": U.needs_rewrite(F.col("text"))})

scalar("is_identity_question",
       {"is_identity": f"regexp_matches(lower(text), '{B}who{E}.*{B}are\\s+you{E}|{B}who\\s+are\\s+you{E}|{B}what\\s+are\\s+you{E}|{B}what\\s+is\\s+your\\s+name{E}|{B}introduce\\s+yourself{E}|{B}tell\\s+me\\s+about\\s+yourself{E}')"},
       lambda: {"is_identity": U.is_identity_question(F.col("text"))})

scalar("clean_rewrite",
       {"cleaned": f"""md5(coalesce(nullif(regexp_replace(replace(replace(trim(concat(' "Rewritten Query: ', case when turn = 0 then '' else text end, '" '), {TRIM}), '"', ''), '''', ''), '{fv.REWRITE_PREFIX_PATTERN}', ''), ''), text))"""},
       lambda: {"cleaned": F.md5(U.clean_rewrite(F.concat(F.lit(' "Rewritten Query: '), F.when(F.col("turn") == 0, "").otherwise(F.col("text")),
                                                          F.lit('" ')), F.col("text")))})

# --- history ----------------------------------------------------------------
@query("truncate_assistant", f"select conv_id, turn, md5({TRUNC}) as md5 from conversations")
def _(spark, sf):
    return H.truncate_assistant(turns(spark, sf)).select("conv_id", "turn", F.md5("text").alias("md5"))


@query("last_turns", """select conv_id, turn, back from (select conv_id, turn, cast(row_number() over (partition by conv_id order by turn desc) - 1 as int) as back
 from conversations) where back < 4""")
def _(spark, sf):
    return H.last_turns(turns(spark, sf), 4).select("conv_id", "turn", "back")


LINE = "concat(case when role = 'user' then 'User: ' else 'Assistant: ' end, {})"


@query("render_transcript", f"""with t as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
 select conv_id, md5(string_agg({LINE.format(TRUNC)}, chr(10) order by turn)) as md5 from t where rn <= 6 group by 1""")
def _(spark, sf):
    return H.render_transcript(turns(spark, sf)).select("conv_id", F.md5("transcript").alias("md5"))


@query("rewrite_input", HISTORY_SQL + f"""6), h as (select query_id, string_agg({LINE.format(TRUNC)}, chr(10) order by back desc) as x from t group by 1)
 select query_id, md5(coalesce(x, '')) as md5 from q left join h using (query_id)""")
def _(spark, sf):
    return H.rewrite_input(questions(spark, sf), turns(spark, sf)).select("query_id", F.md5("transcript").alias("md5"))


@query("history_key", "select conv_id, md5(string_agg(concat(role, ':', text), '|' order by turn)) as md5 from conversations group by 1")
def _(spark, sf):
    return H.history_key(turns(spark, sf)).select("conv_id", F.md5("history").alias("md5"))


@query("history_digest", HISTORY_SQL + f"""100000000), h as (select query_id, string_agg(concat(back, role, ':', {TRUNC}), '|' order by back desc) as x from t group by 1),
 k as (select query_id, coalesce(x, '') as x from q left join h using (query_id))
 select query_id, count(*) over (partition by x) as same_history, x = '' as is_first from k""")
def _(spark, sf):
    d = H.history_digest(questions(spark, sf), turns(spark, sf), segment_turns=3)
    sizes = d.groupBy("history").agg(F.count(F.lit(1)).alias("same_history"))
    return d.join(sizes, "history").select("query_id", "same_history", (F.col("history") == "").alias("is_first"))


@query("assemble_messages", HISTORY_SQL + f"""10), h as (select query_id, count(*) as n, string_agg(concat(case when role = 'user' then 'user' else 'assistant' end, '=', {TRUNC}), '|' order by back desc) as x from t group by 1)
 select query_id, md5(concat_ws('|', 'system={(H.CONTEXT_PROMPT + "some context").replace("'", "''")}', x, concat('user=', text))) as md5, cast(coalesce(n, 0) + 2 as int) as n_messages from q left join h using (query_id)""")
def _(spark, sf):
    q = questions(spark, sf).withColumn("intent", F.lit("RAG")).withColumn("context", F.lit("some context"))
    m = H.assemble_messages(q, turns(spark, sf))
    return m.select("query_id", F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|"))
                    .alias("md5"), F.size("messages").alias("n_messages"))


@query("rewritten_questions", HISTORY_SQL + f"""6), h as (select query_id, string_agg({LINE.format(TRUNC)}, chr(10) order by back desc) as x from t group by 1)
 select query_id, md5(case when q.turn > 0 and {REWRITE_SQL} then concat('asked ', md5(coalesce(x, ''))) else text end) as md5 from q left join h using (query_id)""")
def _(spark, sf):
    def rewriter(asked):
        return asked.select("query_id", F.concat(F.lit("Rewritten query: asked "), F.md5("transcript")).alias("rewritten"))
    return rewritten_questions(questions(spark, sf), turns(spark, sf), rewriter).select("query_id", F.md5("search_text").alias("md5"))
