import re

import pytest
from pyspark.sql import functions as F

from leafquery.llm.pii import FORMS, feistel, luhn_digit, permute_symbols, pseudonymise

TEXTS = [
    "call +1 (017) 555-7713 or the.72@mail3.example.com from 97.51.17.173, card 4845168114407329 or 9807915762804490.",
    "again the.72@mail3.example.com 97.51.17.173 4845168114407329 and 4845-1681-1440-7329 on 2024-02-29",
    "decoys: 2024-02-30 300.1.1.1 666-45-6789 000-12-3456 9807915762804490 v1.2.3.4 12345 a@b 31/02/1999 1.2.3",
    'ssn 123-45-6789, token = "04dbebab91ab85687d33eeaaf9ac699e1188aabb", 31/12/1999 and 31.12.1999 and éè@x.org!',
    "", None, "no digits here", "7536784127813050 4845168114407329", "again the.72@mail3.example.com", "x" * 60000 + " 97.51.17.173",
]


def luhn_ok(s):
    total = 0
    for i, c in enumerate(reversed([c for c in s if c.isdigit()])):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_pseudonyms int")
    return {r.row.doc_id: r for r in pseudonymise(docs, "secret").collect()}


def test_decoys_plain_and_empty_texts_stay(out):
    for k in (2, 4, 5, 6):
        assert out[k].text == TEXTS[k] and out[k].n_pseudonyms == 0


def test_values_keep_their_form_and_link_documents(out):
    a, b = out[0].text, out[1].text
    assert out[0].n_pseudonyms == 4 and "9807915762804490" in a
    values = re.match(r"call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\w{3}\.\d\d@mail3\.example\.com) from (\d+(?:\.\d+){3}), "
                      r"card (\d{16}) or 9807915762804490\.$", a).groups()
    assert not any(v in TEXTS[0] for v in values)
    assert all(v in b for v in values[1:]) and values[1] in out[8].text
    assert luhn_ok(values[3]) and all(int(x) < 256 for x in values[2].split("."))
    dashed = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", b).group()
    assert dashed.replace("-", "") == values[3]  # one number, however it is written
    assert out[9].text == "x" * 60000 + " " + values[2]


def test_other_forms(out):
    m = re.match(r'ssn (\d{3}-\d{2}-\d{4}), token = "([0-9a-f]{40})", (\d\d)/(\d\d)/(\d{4}) and (\d\d)\.(\d\d)\.(\d{4}) and (\w+)@x\.org!$', out[3].text)
    assert m and "123-45-6789" not in out[3].text and "04dbebab" not in out[3].text and "éè" not in out[3].text
    assert m.groups()[2:5] == m.groups()[5:8]  # one date in two formats
    assert out[7].n_pseudonyms == 2


def test_permutations_are_one_to_one(spark):
    rows = spark.range(184 * 7).select(feistel(F.col("id"), F.lit(184).cast("bigint"), F.lit(7).cast("bigint"), F.lit("t"), "k").alias("y"))
    assert sorted(r.y for r in rows.collect()) == list(range(184 * 7))
    three = spark.range(1000).select(permute_symbols(F.lpad(F.col("id").cast("string"), 3, "0"), "0123456789", "t", "k").alias("y"))
    assert len({r.y for r in three.collect()}) == 1000
    assert all(len(r.y) == 3 and r.y.isdigit() for r in three.collect())


def test_keys_differ_and_luhn(spark):
    row = spark.range(1).select(permute_symbols(F.lit("123456789012345678901"), "0123456789", "t", "k1").alias("a"),
                                permute_symbols(F.lit("123456789012345678901"), "0123456789", "t", "k2").alias("b"),
                                luhn_digit(F.lit("484516811440732")).alias("c")).first()
    assert row.a != row.b and len(row.a) == len(row.b) == 21 and row.c == "9"


def test_no_rows(docs_of):
    assert pseudonymise(docs_of([]), "k").count() == 0


def test_forms_need_no_groups():
    assert all("(?" in p and not re.search(r"(?<!\\)\((?!\?)", p) for p in FORMS.values())
