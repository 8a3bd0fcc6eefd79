"""Inputs derived from the given tables by expressions that both engines evaluate.

The texts of ``documents`` and ``conversations`` carry no headings, codes or fees, so
markup is put in front of every whole text. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafquery.functions.staging import spread

NL = "chr(10)"
DOC = "cast(floor(doc_id / 10) as bigint)"
LEVEL = "case when floor(doc_id / 10) % 3 = 0 then 'postgraduate' else 'undergraduate' end"

MARKUP = f"""concat(
  case when doc_id % 3 = 0 then concat('# Department of ', source, {NL})
       when doc_id % 7 = 1 then concat('Faculty of ', lang, {NL}) else '' end,
  case when doc_id % 4 = 1 then concat('Bachelor of ', lang, ' Studies', {NL}) else '' end,
  case when doc_id % 5 = 0 then concat('## Semester ', cast(doc_id % 8 + 1 as string), {NL},
            '| CS-', cast(100 + doc_id % 400 as string), ' | Core Topic | 3-0-3 |', {NL},
            '| EE-', cast(100 + doc_id % 300 as string), ' | Second Subject | 2-1-3 |', {NL})
       when doc_id % 5 = 1 then concat('Tuition fee Rs. ', cast(1000 + doc_id as string), {NL},
            'Hostel charges PKR ', cast(500 + doc_id as string), ',000', {NL})
       when doc_id % 5 = 2 then concat('### Dean Dr. Alpha Beta', {NL}, 'Lecturer Engr. Gamma', {NL})
       else '' end, text)"""

PAGES = {"doc_id": DOC, "academic_level": LEVEL, "year": "cast(2026 as int)",
         "page_no": "cast(doc_id % 10 + 1 as int)", "text": MARKUP}

CHUNKS = {
    "chunk_id": "concat('c', cast(doc_id as string))", "doc_id": DOC, "academic_level": LEVEL,
    "year": "cast(2026 as int)", "page": "cast(doc_id % 10 + 1 as int)",
    "faculty": "case when doc_id % 4 = 0 then null else concat('Faculty of ', lang) end",
    "department": "case when doc_id % 5 = 4 then null else concat('Department of ', source) end",
    "program": "case when doc_id % 6 = 0 then null else concat('Bachelor of ', lang, ' Studies') end",
    "heading": "case when doc_id % 7 = 3 then null else concat('Chapter ', source, ' chairperson') end",
    "heading_path": "case when doc_id % 7 = 3 then null else concat('Chapter ', source, ' chairperson') end",
    "section": """case doc_id % 8 when 0 then 'faculty' when 1 then 'fees' when 2 then 'curriculum' when 3 then 'scholarships'
                       when 4 then 'laboratories' when 5 then 'admission' when 6 then 'eligibility' else 'general' end""",
    "designation": "case when doc_id % 9 = 0 then concat('Lecturer ', lang) when doc_id % 9 = 1 then 'Dean' else null end",
    "chunk_index": "cast(doc_id % 4 as int)", "text": "text",
}

_K = "(conv_id * 3 + turn) % 16"
QUESTION_TEXT = f"""case {_K}
  when 12 then 'fees?' when 13 then 'seat quota' when 14 then 'Electronic'
  else concat(case {_K}
    when 0 then 'Who is the chairperson of Department of src3? ' when 1 then 'What is the tuition fee for CS-101 in semester 3? '
    when 2 then 'Tell me about M.S. and PhD admission. ' when 3 then 'how many seats are available for BS? '
    when 4 then 'first year subjects in second semester ' when 5 then 'what about it? '
    when 6 then 'Who are you? ' when 7 then 'Is Dr. Alpha Beta the dean of src11? '
    when 8 then 'hostel charges and scholarship for masters ' when 9 then 'eligibility criteria for undergrad students '
    when 10 then 'lab facilities of faculty of en ' when 11 then 'Bachelor of de Studies curriculum, EE 205 ' else '' end, text) end"""
QUESTIONS = {"query_id": "conv_id * 1000 + turn", "conv_id": "conv_id", "turn": "turn", "text": QUESTION_TEXT}


TEXT_TABLES = ("documents", "conversations", "pages", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; text tables cost much work per byte and are spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _derive(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in exprs.items()])


def _sql(exprs: dict[str, str], source: str, where: str = "") -> str:
    cols = ", ".join(f"{e} as {n}" for n, e in exprs.items())
    return f"(select {cols} from {source}{' where ' + where if where else ''})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "documents"), PAGES)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _derive(table(spark, sf_dir, "documents"), CHUNKS)
    code = F.expr("case when page % 2 = 0 then array(concat('CS-', cast(100 + page as string)), 'EE 205') "
                  "else array(concat('cs-', cast(100 + page as string))) end")
    return df.withColumn("course_codes", code)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "conversations").filter("role = 'user'"), QUESTIONS)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


PAGES_SQL = _sql(PAGES, "documents")
CHUNKS_SQL = ("(select *, case when page % 2 = 0 then [concat('CS-', cast(100 + page as string)), 'EE 205'] "
              "else [concat('cs-', cast(100 + page as string))] end as course_codes from " + _sql(CHUNKS, "documents") + ")")
QUESTIONS_SQL = _sql(QUESTIONS, "conversations", "role = 'user'")


def shown(column, name: str):
    """A value as text with NULL spelled out, so that both engines print it alike."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit("NULL")).alias(name)


def shown_sql(expr: str, name: str) -> str:
    return f"coalesce(cast({expr} as varchar), 'NULL') as {name}"
