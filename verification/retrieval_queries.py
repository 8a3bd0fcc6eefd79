"""Keyword and vector search, fusion, rerank, pool, context, reuse, and the composed plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafquery.functions.staging import small_side, stage
from leafquery.operators import (bm25 as BM, bm25_blocks as BB, context as CX, dense as D, fuse as FU, pool as PO, rerank as RR,
                                 reuse as RE, segments as SG, understand as U, vocab as K)
from leafquery.operators.ranking import by_score, top_k
from leafquery.plans.ingest import Corpus
from leafquery.plans.retrieve import retrieve
from leafquery.sources import tables as ST

from . import fixtures as fx
from .fixtures import CHUNKS, CHUNKS_SQL, QUESTIONS_SQL, chunks, questions, shown, shown_sql, table, turns
from .ingest_queries import new_folder, TRIM
from .question_queries import (ALIASES_SQL, B, E, N, NAMES_SQL, PG_OPEN, QS, SQL as QSQL, STRATEGY_SQL, UNDERSTOOD_SQL,
                               cosine_sql, tokens_sql, with_vectors)

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- keyword search over documents, benchmark texts as questions -------------
def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("academic_level"), "text")


def benchmark_questions(spark, sf):
    """Every benchmark text asks every language of the documents."""
    langs = table(spark, sf, "documents").select(F.col("lang").alias("academic_level")).filter("academic_level is not null").distinct()
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").crossJoin(small_side(langs))


def bm25_sql(docs: str, asks: str, where: str = "") -> str:
    """CTEs from docs(chunk_id, academic_level, body, ...) and asks(query_id, academic_level, qtext, ...) to sc(query_id, academic_level, chunk_id, score)."""
    return f"""tk as (select academic_level, chunk_id, unnest({tokens_sql('body')}) as token from {docs}),
 tf as (select academic_level, chunk_id, token, count(*) as tf from tk group by all),
 dl as (select academic_level, chunk_id, count(*) as dl from tk group by all),
 cs as (select academic_level, n, coalesce(total, 0) / n as avgdl from (select academic_level, count(*) as n from {docs} group by all)
   left join (select academic_level, count(*) as total from tk group by all) using (academic_level)),
 ix as (select academic_level, token, df, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from
   (select academic_level, token, count(*) as df from tf group by all) join cs using (academic_level)),
 qt as (select query_id, academic_level, token, count(*) as qtf from (select query_id, academic_level, unnest({tokens_sql('qtext')}) as token from {asks}) group by all),
 sc as (select query_id, academic_level, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
   from qt join ix using (academic_level, token) join cs using (academic_level) join tf using (academic_level, token) join dl using (academic_level, chunk_id)
   {where} group by all)"""


BENCH_SQL = f"""with docs as (select doc_id as chunk_id, lang as academic_level, text as body from documents),
 asks as (select item_id as query_id, text as qtext, academic_level from benchmark cross join (select distinct lang as academic_level from documents)),
 {bm25_sql('docs', 'asks')}"""


@query("bm25_index", BENCH_SQL + " select academic_level, token, df, round(idf, 6) as idf, n, round(avgdl, 6) as avgdl from ix join cs using (academic_level)")
def _(spark, sf):
    ix = BM.bm25_index(documents(spark, sf), rows_per_shard=100)
    return ix.terms.join(ix.corpus, "academic_level").select(
        "academic_level", "token", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_segments", SQL["bm25_index"])
def _(spark, sf):
    """The index of all documents after changes: stale texts and foreign chunks first, then replaced, upserted, deleted, united."""
    docs = documents(spark, sf)
    stale = F.concat(F.lit("stale notice "), F.col("academic_level"), F.lit(" "), F.col("chunk_id").cast("string"))
    foreign = docs.withColumn("chunk_id", -F.col("chunk_id") - 1)
    index = SG.SegmentedIndex(spark, new_folder(spark), rows_per_shard=100)
    index.replace(docs.unionByName(foreign), stale)
    index.replace(docs.filter("academic_level = 'en'"))
    index.upsert(docs.filter("academic_level <> 'en'"))
    index.delete(foreign)
    index.compact(2)
    ix = index.index()
    return ix.terms.join(ix.corpus, "academic_level").select(
        "academic_level", "token", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_postings", BENCH_SQL + """ select academic_level, count(*) as postings, cast(sum(tf) as bigint) as tokens, cast(sum(tf * dl) as bigint) as weight
 from tf join dl using (academic_level, chunk_id) group by 1""")
def _(spark, sf):
    ix = BM.bm25_index(documents(spark, sf), rows_per_shard=100)
    return ix.postings.groupBy("academic_level").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"),
                                                     F.sum(F.col("tf") * F.col("doc_len")).alias("weight"))


@query("bm25_search", BENCH_SQL + """ select query_id, academic_level, chunk_id, rank, round(score, 5) as score from (select *,
 cast(row_number() over (partition by query_id, academic_level order by round(score, 6) desc, chunk_id) - 1 as int) as rank from sc) where rank < 10""")
def _(spark, sf):
    hits = BM.bm25_search(benchmark_questions(spark, sf), BM.bm25_index(documents(spark, sf), staged=True), 10)
    return hits.select("query_id", "academic_level", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query("bm25_search_shards", SQL["bm25_search"])
def _(spark, sf):
    index = BM.bm25_index(documents(spark, sf), rows_per_shard=100, staged=True)
    hits = BM.bm25_search(benchmark_questions(spark, sf), index, 10, broadcast_terms=0)
    return hits.select("query_id", "academic_level", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query("bm25_search_blocks", SQL["bm25_search"])
def _(spark, sf):
    """The same rows from posting blocks, where stop words are looked up for candidates only."""
    hits = BB.block_search(benchmark_questions(spark, sf), BB.block_index(documents(spark, sf), staged=True), 10, plain_postings=0)
    return hits.select("query_id", "academic_level", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query("merge_levels", BENCH_SQL + """ select query_id, academic_level, chunk_id, rank from (select *,
 cast(row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) - 1 as int) as rank from sc) where rank < 12""")
def _(spark, sf):
    hits = BM.bm25_search(benchmark_questions(spark, sf), BM.bm25_index(documents(spark, sf), staged=True), 12)
    english = F.col("academic_level") == "en"
    return FU.merge_levels([hits.filter(english), hits.filter(~english)], 12).select("query_id", "academic_level", "chunk_id", "rank")


ALIGNED = "case section when 'scholarships' then 'scholarship' when 'laboratories' then 'laboratory' else section end"
DOCS_SQL = f"""ch as (select * exclude (section, course_codes), {ALIGNED} as section, list_transform(course_codes, lambda c: upper(c)) as course_codes from {CHUNKS_SQL}),
 docs as (select *, concat_ws(' ', program, heading_path, text) as body from ch)"""
FILTER_SQL = """(f_department is null or f_department = ch.department) and (f_section is null or f_section = ch.section)
 and (f_faculty is null or f_faculty = ch.faculty) and (f_course_code is null or list_contains(ch.course_codes, f_course_code))"""


FILTERED_SQL = f"""{QS}, {UNDERSTOOD_SQL}, {DOCS_SQL}, asks as (select query_id, text as qtext, academic_level from q cross join (select distinct academic_level from ch)),
 {bm25_sql('docs', 'asks', 'join uf using (query_id) join ch using (academic_level, chunk_id) where ' + FILTER_SQL)}
 select query_id, academic_level, chunk_id, rank from (select *, cast(row_number() over (partition by query_id, academic_level order by round(score, 6) desc, chunk_id) - 1 as int) as rank from sc) where rank < 10"""


@query("metadata_filter", FILTERED_SQL)
@query("metadata_filter_levels", FILTERED_SQL)
def _(spark, sf):
    """Every question asks every level of the chunk table."""
    ch = BM.searchable(chunks(spark, sf))
    levels = small_side(ch.select("academic_level").distinct())
    u = U.understand(questions(spark, sf), K.all_aliases(chunks(spark, sf))).crossJoin(levels)
    asked = u.select("query_id", "academic_level", "text", "f_department", "f_section", "f_faculty", "f_course_code")
    return BM.bm25_search(asked, BM.bm25_index(ch, BM.rich_text(), staged=True), 10).select("query_id", "academic_level", "chunk_id", "rank")


# --- vector search ----------------------------------------------------------
def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("chunk_id"),
                                                 F.col("embedding").alias("vec"), "label",
                                                 (F.col("vec_id") % 3).cast("string").alias("section"),
                                                 F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") % 3).cast("string")).alias("f_section"))


KNN_SQL = f"""with s as (select a.vec_id as query_id, b.vec_id as chunk_id, round({cosine_sql('a.embedding', 'b.embedding')}, 6) as score
  from embeddings a join embeddings b on a.label = b.label where a.vec_id % 2 = 1 or a.vec_id % 3 = b.vec_id % 3)
 select query_id, chunk_id, rank, score from (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) - 1 as int) as rank from s) where rank < 5"""


@query("knn_search", KNN_SQL)
def _(spark, sf):
    v = vectors(spark, sf)
    return D.knn_search(v.drop("section", "chunk_id"), v.drop("f_section", "query_id"), 5, level="label").select("query_id", "chunk_id", "rank", "score")


@query("knn_search_blocks", KNN_SQL)
def _(spark, sf):
    v = vectors(spark, sf)
    return D.knn_search(v.drop("section", "chunk_id"), v.drop("f_section", "query_id"), 5, level="label", broadcast_rows=0,
                        cell_rows=16, cell_queries=8).select("query_id", "chunk_id", "rank", "score")


@query("retrieval_confidence", f"""with h as ({KNN_SQL}), c as (select query_id, avg(score) as c from h group by 1)
 select vec_id as query_id, round(coalesce(c, 0), 6) as confidence, coalesce(c, 0) < 0.45 as is_low from embeddings left join c on query_id = vec_id""")
def _(spark, sf):
    v = vectors(spark, sf)
    hits = D.knn_search(v.drop("section", "chunk_id"), v.drop("f_section", "query_id"), 5, level="label")
    return D.retrieval_confidence(v, hits).withColumn("confidence", F.round("confidence", 6))


# --- fusion and pool on bounded candidate groups ------------------------------
CANDS = {"query_id": "cast(floor(doc_id / 25) as bigint) * 1000", "fused_rank": "cast(doc_id % 25 as int)", **{
    k: f"({v})" for k, v in CHUNKS.items() if k not in ("doc_id",)}}


def candidates(spark, sf):
    df = table(spark, sf, "documents")
    return df.select(*[F.expr(e).alias(n) for n, e in CANDS.items()])


CANDS_SQL = fx._sql(CANDS, "documents")
SIG = "substr(regexp_replace(lower(text), '\\s+', '', 'g'), 1, 100)"


def fuse_sql(legs: str) -> str:
    """legs(query_id, leg, rank, chunk_id, page, text) -> fz(query_id, fused_rank, rrf_score, chunk_id)."""
    return f"""fk as (select query_id, coalesce(cast(page as varchar), 'Unknown') as pk, {SIG} as sig, max(case when leg = 0 then rank end) as rd,
   max(case when leg = 1 then rank end) as rs, min(leg * 1000 + rank) as first, arg_min(chunk_id, leg * 1000 + rank) as chunk_id from {legs} group by 1, 2, 3),
 fs as (select *, coalesce(1.0::double / (50.0::double + rd), 0) + coalesce(1.0::double / (50.0::double + rs), 0) as rrf_score from fk),
 fz as (select query_id, chunk_id, rrf_score, fused_rank from (select *, cast(row_number() over (partition by query_id order by rrf_score desc, first) - 1 as int) as fused_rank from fs) where fused_rank < 30)"""


RRF_SQL = f"""with c as {CANDS_SQL}, legs as (select query_id, 0 as leg, fused_rank as rank, chunk_id, page % 3 as page, text from c where fused_rank % 3 <> 0
  union all select query_id, 1, 24 - fused_rank, chunk_id, page % 3, text from c where fused_rank % 2 = 0 or fused_rank % 3 = 0), {fuse_sql('legs')}
 select query_id, chunk_id, fused_rank, round(rrf_score, 9) as rrf_score from fz"""


@query("rrf_fuse", RRF_SQL)
@query("rrf_fuse_all", RRF_SQL)
def _(spark, sf):
    """Every candidate stands in a list: of each six ranks two in the dense one, two in the sparse one and two in both."""
    c = candidates(spark, sf).withColumn("page", F.col("page") % 3)
    dense = c.filter("fused_rank % 3 <> 0").withColumnRenamed("fused_rank", "rank")
    sparse = c.filter("fused_rank % 2 = 0 or fused_rank % 3 = 0").withColumn("rank", 24 - F.col("fused_rank")).drop("fused_rank")
    return FU.rrf_fuse(dense, sparse).select("query_id", "chunk_id", "fused_rank", F.round("rrf_score", 9).alias("rrf_score"))


def overlap(a: str, b: str) -> str:
    both = f"({a} <> '' and {b} <> '' and (contains(lower({a}), lower({b})) or contains(lower({b}), lower({a}))))"
    return f"coalesce({both}, false)"


def rerank_sql(rows: str, asked: str) -> str:
    """rows(query_id, fused_rank, rrf_score, metadata) and asked (understood, x_ prefix) -> rk(..., score, rr)."""
    head = "lower(coalesce(nullif(heading_path, ''), nullif(heading, ''), ''))"
    term = (f"len(list_filter(list_concat(regexp_extract_all(x_text, '{B}([A-Z0-9\\-]{{2,15}}){E}', 1), regexp_extract_all(x_text, '{B}([a-zA-Z]{{2,5}}\\s*-?\\s*\\d{{2,4}}){E}', 1)),"
            " lambda t: contains(lower(text), lower(t)))) > 0")
    year = (f"coalesce(case when x_year in ('first', '1st') then regexp_matches({head}, 'first|1st') when x_year in ('second', '2nd') then regexp_matches({head}, 'second|2nd')"
            f" when x_year in ('third', '3rd') then regexp_matches({head}, 'third|3rd') else regexp_matches({head}, 'fourth|4th|final') end, false) and x_year is not null")

    def inside(a, b):
        return f"coalesce({a} <> '' and contains({b}, lower({a})), false)"

    conds = [(0.10, term), (0.08, overlap("x_department", "department")), (0.08, overlap("x_program", "program")),
             (0.10, overlap("x_section", "section")), (0.05, inside("x_department", head)), (0.05, inside("x_section", head)),
             (0.05, inside("x_entity", head)), (0.10, year), (0.10, inside("x_entity", "lower(text)"))]
    boosts = " + ".join(f"(case when {c} then {v}::double else 0.0::double end)" for v, c in conds)
    return f"""qa as (select query_id, text as x_text, department as x_department, program as x_program, section as x_section, entity as x_entity,
   year_level as x_year, list_distinct({tokens_sql('text')}) as x_tokens from {asked}),
 tt as (select c.*, qa.* exclude (query_id), list_distinct({tokens_sql('text')}) as c_tokens from {rows} c join qa using (query_id)),
 jc as (select *, case when len(x_tokens) > 0 and len(c_tokens) > 0 then len(list_intersect(x_tokens, c_tokens))::double
   / (len(x_tokens) + len(c_tokens) - len(list_intersect(x_tokens, c_tokens))) else 0.0 end as jaccard from tt),
 rs as (select *, rrf_score * 0.55::double + jaccard * 0.25::double + {boosts} as score from jc),
 rk as (select *, cast(row_number() over (partition by query_id order by score desc, fused_rank) - 1 as int) as rr from rs)"""


def scored_candidates(spark, sf):
    return candidates(spark, sf).withColumn("rrf_score", 1.0 / (F.lit(50.0) + F.col("fused_rank")))


@query("rerank", f"""{QS}, {UNDERSTOOD_SQL}, c as (select *, 1.0::double / (50.0::double + fused_rank) as rrf_score from {CANDS_SQL}), {rerank_sql('c', 'un')}
 select query_id, chunk_id, rr as rerank_rank, round(score, 9) as score, case when rr < 8 then rr else -1 end as pool_pos from rk""")
def _(spark, sf):
    u = U.understand(questions(spark, sf), K.all_aliases(chunks(spark, sf)))
    out = RR.rerank(scored_candidates(spark, sf), u, 8)
    return out.select("query_id", "chunk_id", "rerank_rank", F.round("rerank_score", 9).alias("score"),
                      F.coalesce("pool_pos", F.lit(-1)).alias("pool_pos"))


#: values that meet inside a group of 25 candidates
MEETING = {"department": "case when fused_rank % 7 = 3 then null else concat('D', cast(fused_rank % 3 as string)) end",
           "section": "case when fused_rank % 6 < 3 then null else concat('S', cast(fused_rank % 2 as string)) end",
           "heading_path": "case when fused_rank % 11 = 5 then null else concat('H', cast(fused_rank % 9 as string)) end",
           "text": "case when fused_rank % 10 = 7 then lang else text end"}


def pool(spark, sf):
    c = candidates(spark, sf).join(table(spark, sf, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "lang"), "chunk_id")
    for name, expr in MEETING.items():
        c = c.withColumn(name, F.expr(expr))
    return c.withColumn("pool_pos", F.expr("case when fused_rank % 4 = 1 then cast(floor(fused_rank / 4) as int) end"))


POOL_SQL = (f"cl as (select c.*, lang from {CANDS_SQL} c join documents d on c.chunk_id = concat('c', cast(d.doc_id as string))), "
            "cd as (select * replace (" + ", ".join(f"{e} as {n}" for n, e in MEETING.items()) + ") from cl), "
            "k0 as (select query_id, fused_rank, cast(floor(fused_rank / 4) as int) as pos from cd where fused_rank % 4 = 1)")


def expand_sql(cands: str, prev: str, name: str, same: str, named: str, lead: str, flag: str = "true") -> str:
    return f"""{name}_k as (select c.*, k.pos from {cands} c join {prev} k using (query_id, fused_rank)),
 {name}_c as (select c.query_id, c.fused_rank, c.text, {lead} as lead from {cands} c join {name}_k k on k.query_id = c.query_id and {same}
   where {flag} and {named} and c.text <> '' and not exists (select 1 from {name}_k t where t.query_id = c.query_id and t.text = c.text) group by all),
 {name}_d as (select * from (select *, row_number() over (partition by query_id, text order by lead, fused_rank) as dup from {name}_c) where dup = 1),
 {name} as (select query_id, fused_rank, pos from {prev} union all select query_id, fused_rank,
   cast(n + row_number() over (partition by query_id order by lead, fused_rank) - 1 as int) from {name}_d join (select query_id, count(*) as n from {prev} group by 1) using (query_id))"""


SECTION_RULE = ("c.department is not distinct from k.department and c.section is not distinct from k.section",
                "(coalesce(c.department, '') <> '' or coalesce(c.section, '') <> '')", "min(k.pos)")
PAGE_RULE = ("c.page = k.page", "coalesce(c.page, 0) <> 0", "min(0)")
TABLE_RULE = ("c.heading_path = k.heading_path", "c.heading_path <> ''", "min(0)")


def _expansion(name, fn, rule):
    sql = f"with {POOL_SQL}, {expand_sql('cd', 'k0', 'k1', *rule)} select query_id, fused_rank, pos from k1"
    query(name, sql)(lambda spark, sf: fn(pool(spark, sf)).filter("pool_pos is not null").select(
        "query_id", "fused_rank", F.col("pool_pos").alias("pos")))


_expansion("expand_section", PO.expand_section, SECTION_RULE)
_expansion("expand_page", PO.expand_page, PAGE_RULE)
_expansion("expand_table", PO.expand_table, TABLE_RULE)


def dedup_sql(rows: str) -> str:
    """rows(query_id, pos, page, chunk_index, text, ...) -> dd with the last row at the first position."""
    return f"""d1 as (select query_id, min(pos) as pos, arg_max(chunk_id, pos) as chunk_id from {rows} group by query_id, page, coalesce(chunk_index, 0), substr(text, 1, 100)),
 d2 as (select d1.query_id, d1.pos, d1.chunk_id, r.chunk_index, r.text from d1 join {rows} r using (query_id, chunk_id)),
 dd as (select query_id, min(pos) as pos, arg_max(chunk_id, pos) as chunk_id from d2 group by query_id, chunk_index, text)"""


def copies(spark, sf):
    """Candidates as a pool in which page and chunk collide and each text comes twice."""
    c = candidates(spark, sf).withColumn("page", F.col("page") % 2).withColumn("chunk_index", F.col("chunk_index") % 2)
    again = c.withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))).withColumn("fused_rank", 49 - F.col("fused_rank"))
    return c.unionByName(again).withColumn("pool_pos", F.col("fused_rank"))


COPIES_SQL = f"""cx as (select * exclude (page, chunk_index), page % 2 as page, chunk_index % 2 as chunk_index, fused_rank as pos from {CANDS_SQL}),
 cp as (select * from cx union all select * replace (concat(chunk_id, 'x') as chunk_id, 49 - fused_rank as fused_rank, 49 - fused_rank as pos) from cx)"""


@query("dedup_pool", f"with {COPIES_SQL}, {dedup_sql('cp')} select query_id, pos, chunk_id from dd")
def _(spark, sf):
    return PO.dedup_pool(copies(spark, sf)).select("query_id", F.col("pool_pos").alias("pos"), "chunk_id")


@query("order_pool", f"with {COPIES_SQL} select query_id, chunk_id, cast(row_number() over (partition by query_id order by page, chunk_index, pos) - 1 as int) as pos from cp")
def _(spark, sf):
    return PO.order_pool(copies(spark, sf)).select("query_id", "chunk_id", "pos")


def pack_sql(rows: str) -> str:
    """rows(query_id, pos, page, academic_level, section, heading_path, heading, text) -> cx(query_id, context)."""
    return f"""p0 as (select * exclude (text), trim(text, {TRIM}) as text from {rows}),
 p1 as (select *, coalesce(nullif({ALIGNED}, ''), 'general') as sec from (select *, row_number() over (partition by query_id, text order by pos) as same from p0 where text <> '') where same = 1),
 p2 as (select *, coalesce(list_position(['faculty','fees','curriculum','eligibility','admission','laboratory','scholarship','research','general'], sec), 100 + min(pos) over (partition by query_id, sec)) as o,
   row_number() over (partition by query_id, sec order by pos) as nth from p1),
 p3 as (select query_id, o, pos, concat('[Source: ', case when academic_level = 'undergraduate' then 'UG Prospectus' else 'PG Prospectus' end, ', Page ', coalesce(cast(nullif(page, 0) as varchar), 'Unknown'), ']', chr(10),
   'Section:', sec, chr(10), coalesce(nullif(heading_path, ''), nullif(heading, ''), ''), chr(10), text, chr(10)) as block from p2 where nth <= 6),
 p4 as (select *, sum(length(block)) over (partition by query_id order by o, pos rows unbounded preceding) as total from p3),
 cx as (select query_id, string_agg(block, chr(10) || '---' || chr(10) order by o, pos) as context from p4 where total <= 12000 group by 1)"""


def ordered(spark, sf):
    return candidates(spark, sf).withColumn("pos", F.col("fused_rank"))


ORDERED_SQL = f"od as (select *, fused_rank as pos from {CANDS_SQL})"


@query("pack_context", f"with {ORDERED_SQL}, {pack_sql('od')} select query_id, md5(context) as md5, length(context) as n_chars from cx")
def _(spark, sf):
    return CX.pack_context(ordered(spark, sf)).select("query_id", F.md5("context").alias("md5"), F.length("context").alias("n_chars"))


@query("pack_context_flat", f"""with {ORDERED_SQL}, p1 as (select * from (select * exclude (text), trim(text, {TRIM}) as text, row_number() over (partition by query_id, trim(text, {TRIM}) order by pos) as same
  from od where trim(text, {TRIM}) <> '') where same = 1),
 p2 as (select *, row_number() over (partition by query_id, coalesce(nullif(section, ''), 'unknown') order by pos) as nth from p1),
 p4 as (select *, sum(length(text)) over (partition by query_id order by pos rows unbounded preceding) as total from p2 where nth <= 6)
 select query_id, md5(string_agg(concat('[Source: ', case when academic_level = 'undergraduate' then 'UG Prospectus' else 'PG Prospectus' end, ', Page Unknown]', chr(10), text),
   chr(10) || '---' || chr(10) || chr(10) order by pos)) as md5 from p4 where total <= 12000 group by 1""")
def _(spark, sf):
    return CX.pack_context_flat(ordered(spark, sf)).select("query_id", F.md5("context").alias("md5"))


RELATED_SQL = f"""with r as (select distinct section, department, academic_level from {CHUNKS_SQL})
 select r.section as asked_section, coalesce(r.department, 'NULL') as asked_department, c.chunk_id from r join {CHUNKS_SQL} c on c.academic_level = r.academic_level
  and c.department is not distinct from r.department and c.section is not distinct from r.section"""


@query("related_chunks", RELATED_SQL)
@query("related_chunks_all", RELATED_SQL)
def _(spark, sf):
    """Every group of the chunk table is asked for, with a department or without."""
    ch = chunks(spark, sf)
    asked = ch.select("section", "department", "academic_level").distinct().withColumn("query_id", F.struct("section", "department"))
    return PO.related_chunks(asked, ch).select(F.col("query_id.section").alias("asked_section"),
                                               F.coalesce("query_id.department", F.lit("NULL")).alias("asked_department"), "chunk_id")


# --- the composed plan ------------------------------------------------------
def asked_questions(spark, sf):
    q = with_vectors(spark, sf, questions(spark, sf))
    level = U.level_from_history(questions(spark, sf), turns(spark, sf))
    return q.join(level, "query_id").withColumn("use_pg", F.col("conv_id") % 3 != 0)


LEVELS_SQL = "lv as (" + QSQL["level_from_history"].replace(QS + ",", "with", 1) + ")"
ASKED_SQL = f"""{LEVELS_SQL}, aq as (select sg.*, lv.is_pg, lv.is_ug, sg.conv_id % 3 <> 0 as use_pg, e.embedding as vec
   from sg join lv using (query_id) join embeddings e on e.vec_id = sg.conv_id)"""
ROUTES_SQL = """ro as (select query_id, 'dense' as leg, dense_k as k, unnest(case when not use_pg then ['undergraduate'] when is_pg and not is_ug then ['postgraduate']
   when is_ug and not is_pg then ['undergraduate'] else ['undergraduate', 'postgraduate'] end) as academic_level from aq
  union all select query_id, 'sparse', sparse_k, unnest(list_concat(case when use_pg and (is_pg or not is_ug) then ['postgraduate'] else [] end,
   case when is_ug or not is_pg then ['undergraduate'] else [] end)) from aq)"""


@query("route_levels", f"{QS}, {UNDERSTOOD_SQL}, {STRATEGY_SQL}, {ASKED_SQL}, {ROUTES_SQL} select query_id, leg, academic_level, k from ro")
def _(spark, sf):
    q = U.choose_strategy(U.understand(asked_questions(spark, sf), K.all_aliases(chunks(spark, sf))))
    return FU.route_levels(q)


def corpus(spark, sf):
    ch = BM.searchable(chunks(spark, sf))
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return Corpus(ch.join(vec, "doc_id", "left"), BM.bm25_index(ch, BM.rich_text(), staged=True), stage(K.all_aliases(ch)), K.keyword_vocab(ch))


_WITH_FILTER = FILTER_SQL.replace("f_department is null", "not aq.uf or f_department is null").replace(
    "f_section is null", "not aq.uf or f_section is null").replace("f_faculty is null", "not aq.uf or f_faculty is null").replace(
    "f_course_code is null", "not aq.uf or f_course_code is null")

RETRIEVE_SQL = f"""{QS}, {UNDERSTOOD_SQL}, {STRATEGY_SQL}, {ASKED_SQL}, {ROUTES_SQL}, {DOCS_SQL},
 asks as (select aq.query_id, aq.text as qtext, ro.academic_level from aq join ro on ro.query_id = aq.query_id and ro.leg = 'sparse'),
 {bm25_sql('docs', 'asks', 'join aq using (query_id) join ch using (academic_level, chunk_id) where ' + _WITH_FILTER)},
 sp as (select query_id, chunk_id, cast(row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) - 1 as int) as rank from sc),
 ds as (select aq.query_id, ch.chunk_id, round({cosine_sql('aq.vec', 'e.embedding')}, 6) as score from aq join ro on ro.query_id = aq.query_id and ro.leg = 'dense'
   join ch on ch.academic_level = ro.academic_level join embeddings e on e.vec_id = ch.doc_id where {_WITH_FILTER}),
 dn as (select query_id, chunk_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) - 1 as int) as rank from ds),
 legs as (select h.query_id, h.leg, h.rank, ch.chunk_id, ch.page, ch.text from (select query_id, 0 as leg, rank, chunk_id from dn join aq using (query_id) where rank < dense_k
   union all select query_id, 1, rank, chunk_id from sp join aq using (query_id) where rank < sparse_k) h join ch using (chunk_id)),
 {fuse_sql('legs')}, fc as (select fz.*, ch.* exclude (chunk_id, text), trim(ch.text, {TRIM}) as text from fz join ch using (chunk_id)),
 {rerank_sql('fc', 'aq')},
 cd as (select rk.*, aq.es, aq.ep, aq.et, case when not aq.is_pg and not aq.is_ug then greatest(aq.rerank_k, 16) else aq.rerank_k end as kk from rk join aq using (query_id)),
 k0 as (select query_id, fused_rank, rr as pos from cd where rr < kk),
 {expand_sql('cd', 'k0', 'k1', *SECTION_RULE, flag='c.es')}, {expand_sql('cd', 'k1', 'k2', *PAGE_RULE, flag='c.ep')},
 {expand_sql('cd', 'k2', 'k3', *TABLE_RULE, flag='c.et')},
 pl as (select cd.*, k3.pos from cd join k3 using (query_id, fused_rank)), {dedup_sql('pl')},
 od as (select c.* exclude (pos), cast(row_number() over (partition by c.query_id order by coalesce(c.page, 9999), coalesce(c.chunk_index, 0), dd.pos) - 1 as int) as pos
   from dd join (select * from pl) c using (query_id, chunk_id)),
 {pack_sql('od')}
 select aq.query_id, md5(coalesce(context, '')) as md5, length(coalesce(context, '')) as n_chars from aq left join cx using (query_id)"""


@query("retrieve", RETRIEVE_SQL)
def _(spark, sf):
    out = retrieve(asked_questions(spark, sf), corpus(spark, sf))
    return out.select("query_id", F.md5("context").alias("md5"), F.length("context").alias("n_chars"))


# --- reuse ------------------------------------------------------------------
def entries(spark, sf):
    """Every assistant turn is an answer stored under the text of the turn before it."""
    t = turns(spark, sf)
    asked = t.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    return t.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), RE.exact_key(F.col("query"), F.lit("")).alias("key"),
        F.length("query").cast("string").alias("size"), F.col("text").alias("answer"), "conv_id", "query")


ENTRIES_SQL = f"""(select a.conv_id * 1000 + a.turn as seq, md5(concat(lower(trim(u.text, {TRIM})), '|')) as key, cast(length(u.text) as varchar) as size, a.text as answer, a.conv_id, u.text as query
  from conversations a join conversations u on u.conv_id = a.conv_id and u.turn = a.turn - 1 where a.role = 'assistant' and u.role = 'user')"""


@query("exact_key", f"""with k as (select conv_id, string_agg(concat(role, ':', text), '|' order by turn) as h from conversations group by 1)
 select conv_id, turn, md5(concat(lower(trim(text, {TRIM})), '|', h)) as key from conversations join k using (conv_id) where role = 'user'""")
def _(spark, sf):
    from leafquery.operators.history import history_key
    h = history_key(turns(spark, sf))
    return turns(spark, sf).filter("role = 'user'").join(h, "conv_id").select("conv_id", "turn", RE.exact_key(F.col("text"), F.col("history")).alias("key"))


@query("exact_lookup", f"""with c as (select key, arg_max(answer, seq) as answer from {ENTRIES_SQL} group by 1),
 q as (select conv_id, turn, md5(concat(lower(trim(text, {TRIM})), '|')) as key from conversations where role = 'user')
 select conv_id, turn, answer is not null as hit, coalesce(md5(answer), 'NULL') as md5 from q left join c using (key)""")
def _(spark, sf):
    cache = entries(spark, sf).groupBy("key").agg(F.max_by("answer", "seq").alias("answer"))
    q = turns(spark, sf).filter("role = 'user'").select("conv_id", "turn", RE.exact_key(F.col("text"), F.lit("")).alias("key"))
    return RE.exact_lookup(q, cache).select("conv_id", "turn", "hit", F.coalesce(F.md5("answer"), F.lit("NULL")).alias("md5"))


@query("fifo_cap", f"""with m as (select size as key, min(seq) as seq, arg_max(answer, seq) as answer from {ENTRIES_SQL} group by 1)
 select key, seq, md5(answer) as md5 from m order by seq desc limit 64""")
def _(spark, sf):
    e = entries(spark, sf).drop("key").withColumnRenamed("size", "key")
    return RE.fifo_cap(e, 64).select("key", "seq", F.md5("answer").alias("md5"))


def semantic_cache(spark, sf):
    e = table(spark, sf, "embeddings").filter("vec_id % 2 = 0")
    return e.select(F.col("vec_id").alias("seq"), (F.col("label") % 2).cast("string").alias("history"), F.col("embedding").alias("vec"),
                    F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("answer"))


@query("semantic_lookup", f"""with s as (select q.vec_id as query_id, c.vec_id as seq, round({cosine_sql('q.embedding', 'c.embedding')}, 6) as score
  from embeddings q join embeddings c on c.vec_id % 2 = 0 and q.label % 2 = c.label % 2),
 b as (select * from (select *, row_number() over (partition by query_id order by score desc, seq) as rn from s) where rn = 1)
 select query_id, seq, score, score >= 0.88 as hit, concat('answer ', cast(seq as varchar)) as answer from b""")
def _(spark, sf):
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2).cast("string").alias("history"),
                                              F.col("embedding").alias("vec"))
    return RE.semantic_lookup(q, semantic_cache(spark, sf)).select("query_id", "seq", "score", "hit", "answer")


@query("semantic_append", f"""select seq, lower(trim(query, {TRIM})) as query, md5(answer) as md5 from {ENTRIES_SQL} order by seq desc limit 512""")
def _(spark, sf):
    e = with_vectors(spark, sf, entries(spark, sf)).select("seq", "query", F.lit("").alias("history"), "vec", "answer")
    old = e.filter("seq % 2 = 0").withColumn("query", F.lower(F.btrim("query")))
    return RE.semantic_append(old, e.filter("seq % 2 = 1")).select("seq", "query", F.md5("answer").alias("md5"))


# --- tables -----------------------------------------------------------------
@query("replace_level", f"""select chunk_id, academic_level, year from {CHUNKS_SQL} where academic_level = 'undergraduate'
 union all select concat(chunk_id, 'n'), academic_level, 2027 from {CHUNKS_SQL} where academic_level = 'postgraduate'""")
def _(spark, sf):
    old = chunks(spark, sf).select("chunk_id", "academic_level", "year")
    new = old.filter("academic_level = 'postgraduate'").select(F.concat("chunk_id", F.lit("n")).alias("chunk_id"), "academic_level",
                                                               F.lit(2027).alias("year"))
    path = new_folder(spark)
    ST.replace_level(old, path)
    ST.replace_level(new, path)
    return spark.read.schema(old.schema).parquet(path)


@query("replaced_level", SQL["replace_level"])
def _(spark, sf):
    old = chunks(spark, sf).select("chunk_id", "academic_level", "year")
    new = old.filter("academic_level = 'postgraduate'").select(F.concat("chunk_id", F.lit("n")).alias("chunk_id"), "academic_level",
                                                               F.lit(2027).alias("year"))
    return ST.replaced(old, new)


@query("cache_snapshot", f"""select seq, md5(query) as query_md5, md5(answer) as answer_md5 from {ENTRIES_SQL}""")
def _(spark, sf):
    e, path = entries(spark, sf).select("seq", "query", "answer"), new_folder(spark)
    ST.save_snapshot(e, path)
    return ST.load_snapshot(spark, path, e.schema).select("seq", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5"))


UPSERT_SQL = """with n as (select md5(text) as id, doc_id as seq, source from documents where doc_id % 3 <> 0 or doc_id % 2 = 1),
 l as (select id, max(seq) as seq, arg_max(source, seq) as source from n group by 1),
 o as (select md5(text) as id, min(doc_id) as seq, arg_min(source, doc_id) as source from documents where doc_id % 3 = 0 group by 1)
 select * from l union all select * from o where id not in (select id from l)"""


@query("upsert_by_id", UPSERT_SQL)
@query("upsert_by_id_all", UPSERT_SQL)
def _(spark, sf):
    """Every document is on the old side, the new side, or (doc_id % 6 = 3) both."""
    d = table(spark, sf, "documents").select(F.md5("text").alias("id"), F.col("doc_id").alias("seq"), "source")
    old = d.filter("seq % 3 = 0").groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("source", "seq").alias("source"))
    return ST.upsert_by_id(old, d.filter("seq % 3 <> 0 or seq % 2 = 1"), "id")


@query("flatten_metadata", f"""select chunk_id, academic_level, coalesce(department, 'NULL') as department, array_to_string(course_codes, ';') as codes,
 case when page % 2 = 0 then concat('[{{"fee_type":"', source, '","amount":"', cast(page as varchar), '"}}]') else 'NULL' end as fees,
 5 + cast(department is not null as int) + cast(page % 2 = 0 as int) as n_keys from {CHUNKS_SQL} join documents using (doc_id)""")
def _(spark, sf):
    src = table(spark, sf, "documents").select("doc_id", "source")
    fee = F.when(F.col("page") % 2 == 0, F.array(F.struct(F.col("source").alias("fee_type"), F.col("page").cast("string").alias("amount"))))
    ch = chunks(spark, sf).join(src, "doc_id").select("chunk_id", "academic_level", "department", "course_codes", fee.alias("fee_entities"),
                                                      "page", "text")
    flat = ST.flatten_metadata(ch)
    return flat.select("chunk_id", "academic_level", F.coalesce("department", F.lit("NULL")).alias("department"),
                       F.array_join("course_codes", ";").alias("codes"), F.coalesce("fee_entities", F.lit("NULL")).alias("fees"),
                       F.size(F.json_object_keys("metadata")).alias("n_keys"))


def status_rows(spark, sf):
    """One status row per source."""
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("academic_level")).agg(F.array_sort(F.collect_set((F.col("doc_id") % 3).cast("int"))).alias("excluded_pages"),
                                                                  F.max("lang").alias("ingestion_status"), F.min("lang").alias("ingestion_error"))


STATUS_SQL = "(select source as academic_level, array_to_string(list_sort(list_distinct(list(doc_id % 3))), ',') as pages, max(lang) as st, min(lang) as er from documents group by 1)"


@query("upsert_status", f"""with o as (select * from {STATUS_SQL} where academic_level < 'src5'),
 n as (select academic_level, case when academic_level < 'src2' then 'failed' else 'completed' end as st, case when academic_level < 'src2' then 'x' end as er from {STATUS_SQL} where academic_level > 'src10')
 select academic_level, coalesce(o.pages, '') as pages, case when n.academic_level is not null then n.st else o.st end as st,
  coalesce(case when n.academic_level is not null then n.er else o.er end, 'NULL') as er from o full join n using (academic_level)""")
def _(spark, sf):
    rows = status_rows(spark, sf)
    low = F.col("academic_level") < "src2"
    new = rows.filter("academic_level > 'src10'").select("academic_level", F.when(low, "failed").otherwise("completed").alias("ingestion_status"),
                                                        F.when(low, "x").alias("ingestion_error"))
    out = ST.upsert_status(rows.filter("academic_level < 'src5'"), new)
    return out.select("academic_level", F.array_join(F.col("excluded_pages").cast("array<string>"), ",").alias("pages"),
                      F.col("ingestion_status").alias("st"), F.coalesce("ingestion_error", F.lit("NULL")).alias("er"))


@query("read_status", f"""select l.academic_level, coalesce(pages, '') as pages, coalesce(st, 'idle') as st, coalesce(er, 'NULL') as er
 from (select distinct source as academic_level from documents) l left join (select * from {STATUS_SQL} where academic_level < 'src5') using (academic_level)""")
def _(spark, sf):
    levels = table(spark, sf, "documents").select(F.col("source").alias("academic_level"))
    out = ST.read_status(status_rows(spark, sf).filter("academic_level < 'src5'"), levels)
    return out.select("academic_level", F.array_join(F.col("excluded_pages").cast("array<string>"), ",").alias("pages"),
                      F.col("ingestion_status").alias("st"), F.coalesce("ingestion_error", F.lit("NULL")).alias("er"))


@query("insert_if_absent", """select md5(text) as username, min(doc_id) as seq from documents where md5(text) not in (select md5(text) from documents where doc_id % 4 = 0) group by 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("username"), F.col("doc_id").alias("seq"))
    return ST.insert_if_absent(d.filter("seq % 4 = 0"), d, "username", "seq")


@query("active_sessions", """select cast(o_orderkey as varchar) as token, c_name as username, cast(o_orderdate as varchar) as expires_at from orders
 join customer on c_custkey = o_custkey where o_orderdate >= timestamp '1999-06-15 00:00:00'""")
def _(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("token"), F.col("o_custkey").alias("user_id"),
                                          F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"))
    out = ST.active_sessions(s, u, F.lit("1999-06-15 00:00:00").cast("timestamp"))
    return out.select("token", "username", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query("role_counts", "select c_mktsegment as role, count(*) as n_users from customer group by 1")
def _(spark, sf):
    return ST.role_counts(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("role")))
