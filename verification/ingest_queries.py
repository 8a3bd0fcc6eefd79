"""Sources, sections, chunks, vectors and vocabularies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafquery.functions import fixed_values as fv, vectors as V
from leafquery.functions.staging import shared_folder
from leafquery.functions.text import strip
from leafquery.operators import chunks as C, embed as E, sections as S, trained as TR, vocab as K
from leafquery.plans import ingest as P
from leafquery.sources import pages as SP, tables as ST

from . import fixtures as fx
from .fixtures import CHUNKS_SQL, PAGES_SQL, chunks, pages, shown, shown_sql, table
from .patterns import bounded, contains_any, first_name

QUERIES, SQL = {}, {}
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
W = r"[\p{L}\p{N}_]"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def marked(spark, sf):
    """One markdown string per document row, with its page mark."""
    return pages(spark, sf).select("doc_id", "academic_level", "year", "page_no",
                                   SP.page_block(F.col("page_no"), F.col("text")).alias("text"))


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


MARKED_SQL = (f"(select doc_id, academic_level, year, page_no, concat('## Page ', cast(page_no as string), chr(10), chr(10), "
              f"text) as text from {PAGES_SQL})")

# --- sources ----------------------------------------------------------------
PART_SQL = """select ps_part, count(*) as n_rows, cast(sum(len) as bigint) as n_chars from
 (select concat('p', cast(page_no as string)) as ps_part, length(text) as len from {src}) group by ps_part"""


@query("read_pages", f"select doc_id, academic_level, year, page_no, md5(text) as md5 from {PAGES_SQL}")
def _(spark, sf):
    path = new_folder(spark)
    pages(spark, sf).write.parquet(path)
    return SP.read_pages(spark, path).select("doc_id", "academic_level", "year", "page_no", F.md5("text").alias("md5"))


@query("corpus_chunks", f"""select count(*) as n_chunks, count(*) as n_ids, count(distinct doc_id) as n_docs
 from (select doc_id, text from {CHUNKS_SQL})""")
def _(spark, sf):
    kept = P.build_corpus(chunks(spark, sf).withColumn("chunk_id", F.sha2(F.concat_ws("|", "doc_id", "chunk_id"), 256))).chunks
    return kept.agg(F.count("*").alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids"), F.countDistinct("doc_id").alias("n_docs"))


@query("export_read_chunks", f"select chunk_id, academic_level, year, md5(text) as md5 from {CHUNKS_SQL}")
def _(spark, sf):
    path = new_folder(spark)
    ST.export_chunks(chunks(spark, sf), path, fmt="json")
    return ST.read_chunks(spark, path, fmt="json").select("chunk_id", "academic_level", "year", F.md5("text").alias("md5"))


def excluded(spark, sf):
    """Listed pages per level, taken from the data: every page number one of its semester pages has."""
    df = pages(spark, sf).filter(F.contains("text", F.lit("## Semester 3")))
    return df.groupBy("academic_level").agg(F.collect_set("page_no").alias("excluded_pages"))


EXCLUDED_SQL = f"(select distinct academic_level, page_no from {PAGES_SQL} where contains(text, '## Semester 3'))"


@query("split_pages", f"""with p as {PAGES_SQL}, x as {EXCLUDED_SQL}
 select doc_id, academic_level, old_no, new_no, side from (
  select doc_id, academic_level, page_no as old_no, cast(row_number() over (partition by doc_id order by page_no) as int) as new_no, 'main' as side
  from p where not exists (select 1 from x where x.academic_level = p.academic_level and x.page_no = p.page_no)
  union all select doc_id, academic_level, page_no, page_no, 'seat'
  from p where exists (select 1 from x where x.academic_level = p.academic_level and x.page_no = p.page_no))""")
def _(spark, sf):
    tagged = pages(spark, sf).withColumn("old_no", F.col("page_no"))
    main, seat = SP.split_pages(tagged, excluded(spark, sf))
    cols = ["doc_id", "academic_level", "old_no", F.col("page_no").alias("new_no")]
    return main.select(*cols, F.lit("main").alias("side")).unionByName(seat.select(*cols, F.lit("seat").alias("side")))


SPEC = "concat(' ', cast(doc_id % 90 as string), ' , ,', cast(doc_id % 7 as string), ',')"


@query("parse_excluded_pages", f"""select doc_id, case when lang = 'en' then concat(cast(doc_id % 90 as string), ';', cast(doc_id % 7 as string))
 else '' end as parsed from documents""")
def _(spark, sf):
    level = F.when(F.col("lang") == "en", "undergraduate").otherwise("postgraduate")
    return table(spark, sf, "documents").select("doc_id", F.array_join(
        SP.parse_excluded_pages(F.expr(SPEC), level).cast("array<string>"), ";").alias("parsed"))


@query("scan_density", f"""with p as {PAGES_SQL}, n as (select *, max(page_no) over (partition by doc_id) as m from p)
 select doc_id, count(*) as sampled_pages, round(avg(length(trim(text, {TRIM}))), 6) as avg_chars,
 avg(length(trim(text, {TRIM}))) < 15 as is_scanned from n where page_no <= 5 or page_no > greatest(m - 5, 5) group by doc_id""")
def _(spark, sf):
    return SP.scan_density(pages(spark, sf)).withColumn("avg_chars", F.round("avg_chars", 6))


@query("assemble_markdown", f"""with p as {MARKED_SQL} select doc_id, 0 as part_no, md5(string_agg(text, chr(10) || chr(10) order by page_no)) as md5,
 cast(sum(length(text)) + 2 * (count(*) - 1) as bigint) as n_chars from p group by doc_id""")
def _(spark, sf):
    return SP.assemble_markdown(pages(spark, sf)).select(
        "doc_id", "part_no", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n_chars"))


# --- sections ---------------------------------------------------------------
@query("split_page_blocks", f"""with m as (select doc_id, string_agg(text, chr(10) || chr(10) order by page_no) as md from {MARKED_SQL} group by doc_id),
 b as (select doc_id, unnest(string_split(regexp_replace(md, '(?m)^(##\\s*Page\\s*\\d+)', chr(1) || '\\1', 'g'), chr(1))) as block from m)
 select doc_id, md5(block) as md5, length(block) as n_chars from b where trim(block, {TRIM}) <> ''""")
def _(spark, sf):
    md = SP.assemble_markdown(pages(spark, sf))
    return S.split_page_blocks(md).select("doc_id", F.md5("text").alias("md5"), F.length("text").alias("n_chars"))


SECTIONS_SQL = f"""with m as {MARKED_SQL},
 a as (select doc_id, page_no, string_split(regexp_replace(text, '(?m)^(#{{1,6}}\\s+.+)$', chr(1) || '\\1', 'g'), chr(1)) as parts from m),
 s as (select doc_id, page_no, unnest(case when len(parts) > 1 then parts[2:] else parts end) as part from a),
 sec as (select doc_id, page_no, trim(part, {TRIM}) as text from s where trim(part, {TRIM}) <> '')"""


def sections(spark, sf):
    return S.split_heading_sections(marked(spark, sf))


@query("split_heading_sections", SECTIONS_SQL + " select doc_id, page_no, md5(text) as md5, length(text) as n_chars from sec")
def _(spark, sf):
    return sections(spark, sf).select("doc_id", "page_no", F.md5("text").alias("md5"), F.length("text").alias("n_chars"))


HEADS = "regexp_extract_all(text, '(?m)^#{1,6}[\\t ]+(.+)$', 1)"


@query("heading_path", SECTIONS_SQL + f""", h as (select doc_id, page_no, md5(text) as md5, list_transform({HEADS}, lambda x: trim(x, {TRIM})) as hs from sec)
 select doc_id, page_no, md5, case when len(hs) = 0 then 'NULL' else array_to_string(hs, ' > ') end as heading_path,
 case when len(hs) = 0 then 'NULL' else hs[-1] end as heading_leaf, cast(len(hs) as int) as heading_depth from h""")
def _(spark, sf):
    h = S.heading_columns(F.col("text"))
    return sections(spark, sf).select("doc_id", "page_no", F.md5("text").alias("md5"), shown(h["heading_path"], "heading_path"),
                                      shown(h["heading_leaf"], "heading_leaf"), h["heading_depth"].alias("heading_depth"))


@query("classify_section", SECTIONS_SQL + f""" select doc_id, page_no, md5(text) as md5,
 {first_name("lower(text)", fv.DOCUMENT_SECTIONS, "general")} as section from sec""")
def _(spark, sf):
    return sections(spark, sf).select("doc_id", "page_no", F.md5("text").alias("md5"),
                                      S.classify_section(F.col("text")).alias("section"))


CODE = bounded(fv.COURSE_PATTERN, capture=True)


@query("classify_content", SECTIONS_SQL + f""" select doc_id, page_no, md5(text) as md5, case when not contains(text, '|') then 'text'
 when regexp_matches(text, '{CODE}') then 'curriculum_table'
 when {contains_any("lower(text)", fv.FEE_TABLE_WORDS)} then 'fee_table' else 'table' end as content_type from sec""")
def _(spark, sf):
    return sections(spark, sf).select("doc_id", "page_no", F.md5("text").alias("md5"),
                                      S.classify_content(F.col("text")).alias("content_type"))


PERSON, DESIGNATION = fv.PERSON_PATTERN, bounded(fv.DESIGNATION_PATTERN)


@query("first_match_fields", SECTIONS_SQL + f""" select doc_id, page_no, md5(text) as md5,
 coalesce(nullif(regexp_extract(text, '{fv.SEMESTER_PATTERN}', 1), ''), 'NULL') as semester,
 coalesce(nullif(trim(regexp_extract(text, '{CODE}', 1), {TRIM}), ''), 'NULL') as course_code,
 coalesce(nullif(trim(regexp_extract(text, '{PERSON}', 0), {TRIM}), ''), 'NULL') as person_name,
 coalesce(nullif(trim(regexp_extract(text, '{DESIGNATION}', 1), {TRIM}), ''), 'NULL') as designation from sec""")
def _(spark, sf):
    f = S.first_match_fields(F.col("text"))
    return sections(spark, sf).select("doc_id", "page_no", F.md5("text").alias("md5"), *[shown(c, n) for n, c in f.items()])


PROGRAM = bounded(fv.PROGRAM_PATTERN)


@query("all_codes_and_programs", SECTIONS_SQL + f""" select doc_id, page_no, md5(text) as md5,
 array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{CODE}', 1))), ';') as course_codes,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{PROGRAM}', 1),
   lambda x: trim(trim(x, {TRIM}), '*:_#')))), ';') as programs from sec""")
def _(spark, sf):
    f = S.all_codes_and_programs(F.col("text"))
    return sections(spark, sf).select("doc_id", "page_no", F.md5("text").alias("md5"),
                                      *[F.array_join(c, ";").alias(n) for n, c in f.items()])


def _exploded(spark, sf, rows, fields):
    df = sections(spark, sf).select("doc_id", "page_no", F.explode(rows).alias("r"))
    return df.select("doc_id", "page_no", *[F.col(f"r.{f}").alias(f) for f in fields])


FACULTY_ROW, COURSE_ROW, FEE_ROW = fv.FACULTY_ROW_PATTERN, fv.COURSE_ROW_PATTERN, fv.FEE_ROW_PATTERN


def _row_sql(pattern, names, stripped=()):
    lists = ", ".join(f"regexp_extract_all(text, '{pattern}', {i + 1}) as g{i}" for i in range(len(names)))
    cols = ", ".join(f"trim(unnest(g{i}), {TRIM}) as {n}" if n in stripped else f"unnest(g{i}) as {n}"
                     for i, n in enumerate(names))
    return SECTIONS_SQL + f", r as (select doc_id, page_no, {lists} from sec) select doc_id, page_no, {cols} from r"


@query("extract_faculty_rows", _row_sql(FACULTY_ROW, ["designation", "person_name"], ("person_name",)))
def _(spark, sf):
    return _exploded(spark, sf, S.extract_faculty_rows(F.col("text")), ["designation", "person_name"])


@query("extract_course_rows", _row_sql(COURSE_ROW, ["course_code", "course_title", "credit_hours"], ("course_title",)))
def _(spark, sf):
    return _exploded(spark, sf, S.extract_course_rows(F.col("text")), ["course_code", "course_title", "credit_hours"])


@query("extract_fee_rows", f"""select *, coalesce(nullif(replace(amount, ',', ''), ''), 'NULL') as amount_number from
 ({_row_sql(FEE_ROW, ["fee_type", "amount"])})""")
def _(spark, sf):
    return _exploded(spark, sf, S.extract_fee_rows(F.col("text")), ["fee_type", "amount"]).withColumn(
        "amount_number", shown(S.fee_amount(F.col("amount")), "x"))


DEPT_RE, FAC_RE = fv.DEPARTMENT_PATTERN, fv.FACULTY_PATTERN


def _cap(pattern):
    return f"case when regexp_matches(text, '{pattern}') then trim(trim(regexp_extract(text, '{pattern}', 1), {TRIM}), '*:_#') end"


CARRY_SQL = f"""with m as {MARKED_SQL},
 a as (select doc_id, page_no, text, string_split(regexp_replace(text, '(?m)^(#{{1,6}}\\s+.+)$', chr(1) || '\\1', 'g'), chr(1)) as parts from m),
 x as (select doc_id, page_no, text, case when len(parts) > 1 then parts[2:] else parts end as parts from a),
 r as (select doc_id, page_no, -1 as sec, text from x union all
       select doc_id, page_no, unnest(range(len(parts))) as sec, trim(unnest(parts), {TRIM}) as text from x),
 h as (select *, {HEADS} as hs from r where text <> ''),
 d as (select *, list_filter(hs, lambda y: contains(lower(y), 'department') or contains(lower(y), 'dept')) as dh,
   list_filter(hs, lambda y: contains(lower(y), 'faculty') and not contains(lower(y), 'department') and not contains(lower(y), 'dept')) as fh from h),
 v as (select doc_id, page_no, sec, text,
   nullif(regexp_extract(text, '(?m)^##\\s*Page\\s*(\\d+)', 1), '') as page,
   coalesce(case when len(fh) > 0 then trim(replace(fh[-1], 'Faculty of', ''), {TRIM}) end, {_cap(FAC_RE)}) as faculty,
   coalesce(case when len(dh) > 0 then trim(replace(dh[-1], 'Department of', ''), {TRIM}) end, {_cap(DEPT_RE)}) as department,
   {_cap(PROGRAM)} as program from d),
 f as (select doc_id, page_no, sec, md5(text) as md5, {", ".join(
   f"last_value({c} ignore nulls) over w as {c}" for c in ("page", "faculty", "department", "program"))}
   from v window w as (partition by doc_id order by page_no, sec rows unbounded preceding))
 select doc_id, page_no, md5, {", ".join(shown_sql(c, c) for c in ("page", "faculty", "department", "program"))} from f where sec >= 0"""


@query("carry_context", CARRY_SQL)
def _(spark, sf):
    out = S.carry_context(marked(spark, sf), order=("page_no",), pages_per_segment=3, staged=True)
    return out.select("doc_id", "page_no", F.md5("text").alias("md5"), *[
        shown(c, c) for c in ("page", "faculty", "department", "program")])


# --- chunks -----------------------------------------------------------------
@query("shield_tables", SECTIONS_SQL + """ select doc_id, page_no, md5(text) as md5, contains(text, '|') as is_table,
 case when contains(text, '|') then length(text) else -1 end as chunk_size from sec""")
def _(spark, sf):
    rows = sections(spark, sf).withColumn("content_type", S.classify_content(F.col("text")))
    tables, prose = C.shield_tables(rows)
    cols = ["doc_id", "page_no", F.md5("text").alias("md5")]
    return tables.select(*cols, F.lit(True).alias("is_table"), "chunk_size").unionByName(
        prose.select(*cols, F.lit(False).alias("is_table"), F.lit(-1).alias("chunk_size")))


@query("split_by_headers")
def _(spark, sf):
    whole = marked(spark, sf).withColumn("heading_path", F.lit(None).cast("string"))
    return C.split_by_headers(whole).select("doc_id", "page_no", "header_seq", "h1", "h2", "h3", "h4", "heading_path",
                                            F.md5("text").alias("md5"))


@query("split_text")
def _(spark, sf):
    return C.split_text(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "chunk_index", "chunk_size", F.md5("text").alias("md5"))


@query("split_fixed", """with i as (select doc_id, text, unnest(range(0, greatest(length(text) - 301, 0) // 1700 + 1)) as i from documents where length(text) > 0)
 select doc_id, cast(i as int) as chunk_index, md5(substr(text, i * 1700 + 1, 2000)) as md5, length(substr(text, i * 1700 + 1, 2000)) as chunk_size from i""")
def _(spark, sf):
    return C.split_fixed(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "chunk_index", F.md5("text").alias("md5"), "chunk_size")


@query("embedding_text", f"""select chunk_id, md5(concat_ws(chr(10), case when faculty <> '' then 'Faculty: ' || faculty end,
 case when department <> '' then 'Department: ' || department end, case when program <> '' then 'Program: ' || program end,
 case when heading_path <> '' then 'Path: ' || heading_path end, text)) as md5 from {CHUNKS_SQL}""")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", F.md5(C.embedding_text()).alias("md5"))


@query("chunk_id", f"""select chunk_id as row_id, sha256(concat(academic_level, '|', coalesce(cast(case when doc_id % 2 = 0 then year end as string), 'None'), '|',
 cast(page as string), '|', cast(chunk_index as string), '|', substr(text, 1, 200))) as id from {CHUNKS_SQL}""")
def _(spark, sf):
    df = chunks(spark, sf).withColumn("year", F.when(F.col("doc_id") % 2 == 0, F.col("year")))
    return df.select(F.col("chunk_id").alias("row_id"), C.chunk_id().alias("id"))


@query("ingest_report", SECTIONS_SQL + f""", lv as (select distinct doc_id, academic_level from {PAGES_SQL})
 select p.academic_level, p.n as pages, s.n as documents, c.n as chunks from
 (select academic_level, count(*) as n from {PAGES_SQL} group by 1) p
 join (select academic_level, count(*) as n from sec join lv using (doc_id) group by 1) s using (academic_level)
 join (select academic_level, count(*) as n from {CHUNKS_SQL} group by 1) c using (academic_level)""")
def _(spark, sf):
    return C.ingest_report(pages(spark, sf), sections(spark, sf), chunks(spark, sf))


@query("ingest_chunks")
def _(spark, sf):
    return P.chunks_of_pages(pages(spark, sf)).select(
        "chunk_id", "doc_id", "page", "department", "faculty", "program", "section", "content_type", "heading_path",
        "chunk_index", "chunk_size")


# --- vectors ----------------------------------------------------------------
@query("embed", f"""with t as (select doc_id, cast('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '{W}+'))), 1, 8) as bigint) as h from documents),
 s as (select doc_id, cast((h >> 1) % 64 as int) as dim, cast(sum(case when h % 2 = 1 then 1 else -1 end) as double) as v from t group by 1, 2),
 n as (select *, greatest(sqrt(sum(v * v) over (partition by doc_id)), 1e-9) as n from s)
 select doc_id, dim, round(cast(cast(v / n as float) as double), 6) as value from n where v <> 0""")
def _(spark, sf):
    df = E.embed(table(spark, sf, "documents"), dimension=64, load=lambda: E.hashing_encoder(64))
    return df.select("doc_id", F.posexplode("vec").alias("dim", "v")).filter("v <> 0").select(
        "doc_id", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("mean_pool", """with t as (select label, vec_id % 5 as mask, unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as d from embeddings),
 s as (select label, d, sum(cast(v as double) * mask) / greatest(sum(mask), 1e-9) as v from t group by 1, 2)
 select label, d as dim, round(v, 6) as value from s""")
def _(spark, sf):
    tokens = table(spark, sf, "embeddings").select(F.col("label").alias("id"), (F.col("vec_id") % 5).alias("mask"),
                                                   F.col("embedding").alias("vec"))
    pooled = V.mean_pool(tokens).select(F.col("id").alias("label"), F.posexplode("vec").alias("d", "v"))
    return pooled.select("label", (F.col("d") + 1).alias("dim"), F.round("v", 6).alias("value"))


@query("cls_pool", """select label, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total
 from embeddings e where vec_id = (select min(vec_id) from embeddings f where f.label = e.label)""")
def _(spark, sf):
    tokens = table(spark, sf, "embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("pos"),
                                                   F.col("embedding").alias("vec"))
    return V.cls_pool(tokens).select(F.col("id").alias("label"), F.round(
        F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


SCALED = "list_transform(embedding, lambda x: cast(x as double) * (vec_id % 3))"


@query("l2_normalize", f"""with s as (select vec_id, {SCALED} as v from embeddings),
 n as (select vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9) as n from s)
 select vec_id, cast(i as int) as place, round(v[i + 1] / n, 6) + 0.0 as value from n, unnest(range(len(v))) as r(i)""")
def _(spark, sf):
    v = F.transform(V.as_doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 3))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(v)).alias("place", "value")).select(
        "vec_id", "place", (F.round("value", 6) + 0.0).alias("value"))


@query("cosine", """with c as (select label, embedding as e from embeddings x where vec_id = (select min(vec_id) from embeddings y where y.label = x.label))
 select vec_id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(e, lambda x: cast(x as double)))
  / sqrt(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(embedding, lambda x: cast(x as double))))
  / sqrt(list_dot_product(list_transform(e, lambda x: cast(x as double)), list_transform(e, lambda x: cast(x as double)))), 6) as cosine
 from embeddings join c using (label)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return e.join(first, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))


# --- vocabularies -----------------------------------------------------------
@query("keyword_vocab", f"""with n as (select replace(replace(lower(department), 'department of ', ''), 'dept of ', '') as x from {CHUNKS_SQL}
  union select lower(designation) from {CHUNKS_SQL}),
 w as (select regexp_replace(unnest(string_split_regex(trim(x, {TRIM}), '\\s+')), '[^\\p{{L}}]', '', 'g') as word from n where x is not null)
 select word from w where length(word) > 3 union select lang from documents""")
def _(spark, sf):
    stored = table(spark, sf, "documents").select(F.col("lang").alias("word"))
    return K.keyword_vocab(chunks(spark, sf), stored)


def _alias_sql(column, condition, extra):
    clean = f"trim(regexp_replace(lower(name), '^[0-9.\\(i\\)]+\\s*', ''), {TRIM})"
    return f"""with n as (select distinct trim({column}, {TRIM}) as name from {CHUNKS_SQL} where {column} is not null),
 k as (select name, lower(name) as a, {clean} as c from n where name <> '' and {condition}),
 x as (select name, a as alias from k union select name, c from k union select name, trim({extra}, {TRIM}) from k where length(trim({extra}, {TRIM})) > 2)
 select name, trim(regexp_replace(alias, '\\s+', ' ', 'g'), {TRIM}) as alias from x where length(alias) > 2"""


@query("department_aliases", _alias_sql("department", "length(name) <= 80",
       "case when contains(c, 'department') then replace(replace(replace(c, 'departments', ''), 'department', ''), 'of', '') end"))
def _(spark, sf):
    return K.department_aliases(chunks(spark, sf)).drop("kind")


@query("faculty_aliases", _alias_sql("faculty", "length(name) <= 80 and lower(name) not in ('the', 'faculty', 'departments', 'faculty members', 'members')",
       "case when contains(c, 'faculty') then replace(replace(c, 'faculty', ''), 'of', '') end"))
def _(spark, sf):
    return K.faculty_aliases(chunks(spark, sf)).drop("kind")


@query("program_aliases", _alias_sql("program", "length(name) <= 80",
       "regexp_replace(c, '^(bs|ms|bachelor of|master of|phd|m\\.?s\\.?|b\\.?s\\.?|b\\.?e\\.?)\\s+', '')"))
def _(spark, sf):
    return K.program_aliases(chunks(spark, sf)).drop("kind")


@query("designation_terms", f"select distinct lower(trim(designation)) as term from {CHUNKS_SQL} where designation is not null and length(trim(designation)) between 1 and 50")
def _(spark, sf):
    return K.designation_terms(chunks(spark, sf)).select(F.col("name").alias("term"))


# --- a trained encoder ------------------------------------------------------
@query("embed_trained")
def _(spark, sf):
    """Vectors of all documents by an encoder trained on all of them; no SQL, tests hold it against numpy."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return TR.embed_trained(docs, TR.train(docs, dimension=32, steps=4)).select("chunk_id", "vec")
