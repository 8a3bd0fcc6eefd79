"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafquery.llm import (boundaries, collocations, decontaminate, jaccard, langid, licences, line_dedup, packing, pii,
                           prefix_trie, quality, rules, substrings)

PII_KEY = "key of the registered query"  # a real run passes its own secret


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes",
                      (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("row.doc_id", "text", "n_pseudonyms")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = rules.apply_rules(docs, rules.learn_rules(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      "base_failed", "kept")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # outer, so that no filter on the hits is pushed below and finds them twice
    return out.select("row.doc_id", F.explode_outer("hits").alias("hit")).filter("hit is not null").select(
        "doc_id", "hit.item_id", F.col("hit.start").alias("start_word"), "hit.n_words", "hit.n_equal")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("row.doc_id", "sentences", "licences")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("row.doc_id", "held_out", "lang_pred", "score")


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = boundaries.write_ids(table(spark, sf_dir, "documents"))
    return boundaries.read_ids(manifest).withColumnRenamed("id", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_table(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_quality_rules": op6_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_token_ids": op11_token_ids,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op3_line_dedup": f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct rid) >= 10),
m as (select k.*, c.key is not null as gone from k left join c on k.key = c.key),
s as (select rid, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from m group by rid)
select d.doc_id, s.n_lines, s.n_dropped, sha256(s.kept) as kept_sha256 from d join s using (rid)
""",
    "op12_collocations": """
with d as (select row_number() over () as rid, coalesce(lang, 'und') as lang,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda w: w <> '') as ws from
      (select lang, unnest(string_split_regex(text, '[.,;:!?\\n-\\r]')) as piece from d)),
t as (select lang, cast(sum(len(ws)) as bigint) as n from p group by lang),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from p),
g as (select lang, ws[i:i + m - 1] as ph, m from i, (select unnest(range(1, 6)) as m) where i + m - 1 <= len(ws)),
f as (select lang, ph, count(*) as f from g group by lang, ph having count(*) >= 100),
c as (select lang, ph, f as a from f where len(ph) >= 2),
o as (select distinct s.lang, s.ph from (select lang, a, unnest([ph[1:len(ph) - 1], ph[2:]]) as ph from c where len(ph) > 2) l
      join c s on s.lang = l.lang and s.ph = l.ph and l.a >= s.a),
k as (select c.*, unnest(range(1, len(ph))) as k from c anti join o on o.lang = c.lang and o.ph = c.ph),
x as (select k.lang, k.ph, a, k, x.f as l, y.f as r, n, cast((1000::hugeint * a * n) // (x.f::hugeint * y.f) as bigint) as score
      from k join t on t.lang = k.lang join f x on x.lang = k.lang and x.ph = k.ph[1:k] join f y on y.lang = k.lang and y.ph = k.ph[k + 1:]),
b as (select * from (select *, row_number() over (partition by lang, ph order by score, k) as pos from x) where pos = 1),
r as (select *, array_to_string(ph, ' ') as phrase from b),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from r)
select lang, rank, phrase, a, l, r, n, score from z where rank <= 2000
""",
    "op13_prefix_trie": f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
      row_number() over (partition by conv_id order by turn nulls first, role, text) as i from conversations where conv_id is not null),
c as (select conv_id, {_CRC32} % 6 as h, conv_id - conv_id % 100 as host from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, t.i, t.role, t.text from c join t on t.conv_id = c.host and t.i <= c.h
      union all select conv_id, 1, i, role, text from c join t using (conv_id) where i > h),
s as (select conv_id, coalesce(list({{'role': role, 'text': text}} order by own, i) filter (own is not null), []) as seq
      from c left join r using (conv_id) group by conv_id),
p as (select conv_id, seq, unnest(range(len(seq) + 1)) as d from s),
n as (select d, seq[1:d] as key, min(conv_id) as conv_id, count(*) as n_convs,
      coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(seq) = d), '') as ends from p group by 1, 2),
k as (select d - 1 as d, key[1:d - 1] as key, count(*) as n_children from n where d > 0 group by 1, 2),
v as (select n.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * length(key[d].text) end as saved
      from n left join k using (d, key)),
a as (select *, unnest(range(d + 1)) as up from v),
u as (select up as d, key[1:up] as key, cast(sum(saved) as bigint) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from a group by 1, 2)
select v.conv_id, v.d as depth, f.conv_id as parent_conv_id, v.n_convs, v.n_children, u.n_leaves, u.saved_tokens, sha256(v.ends) as ends_sha256
from v join u using (d, key) left join v f on f.d = v.d - 1 and f.key = v.key[1:v.d - 1]
""",
}
