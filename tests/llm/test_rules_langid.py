import os
import re

import numpy as np
import pyarrow as pa
import pytest

from leafquery.llm import langid, rules

SF_DIR = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 5000, "é# $%\n\né# $%\nb|<>&*",
         "l\nl\n l\n", " ".join(str(i % 11) for i in range(60)), "A!? B\tc\x0bd", "one two three four five six seven eight nine one two three four five six seven eight"]


def test_statistics_equal_brute_force(docs_of):
    docs = docs_of(list(enumerate(TEXTS)) + [(3, TEXTS[3])])
    out = rules.apply_rules(docs, []).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        want = brute(TEXTS[r.row.doc_id])
        assert (r.stats.n_words, r.stats.word_chars, r.stats.n_symbols, r.stats.n_dup_lines, r.stats.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)
    assert rules.apply_rules(docs_of([]), []).count() == 0


def test_covering_learns_conjunctions_and_emits_them_in_order(docs_of):
    rng = np.random.default_rng(0)
    x = {n: rng.random(3000) for n in ("upper", "marks", "n_words")}
    bad = ((x["upper"] > 0.7) & (x["marks"] > 0.5)) | (x["n_words"] < 0.1)
    learned = rules.learn(x, bad)
    held = np.zeros(3000, bool)
    for rule in learned:
        held |= rules._holds(rule, x)
    assert (held == bad).mean() > 0.97 and all(len(r) <= 4 for r in learned)
    assert rules.learn(x, np.zeros(3000, bool)) == []
    list_ = [(rules.Condition("n_words", False, 3.0),), (rules.Condition("upper", True, 0.5), rules.Condition("n_words", True, 25.0))]
    out = {r.row.doc_id: r.kept for r in rules.apply_rules(docs_of([(1, "w " + " ".join(f"v{i}" for i in range(30))), (2, " ".join(f"V{i % 3}{'X' * i}" for i in range(40)))]), list_).collect()}
    assert out == {1: True, 2: False}
    assert str(list_[1][0]) == "upper >= 0.5"


def test_rules_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.learn_rules(docs_of([(1, "a")]), none) == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_learned_list_keeps_good_and_rejects_bad(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    third = "crc32(cast(doc_id as string)) % 3 = 1"
    learned = rules.learn_rules(docs, labels.filter(f"not ({third})"))
    out = rules.apply_rules(docs, learned).selectExpr("row.doc_id", "kept", "base_failed").join(labels.filter(third), "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in out if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.2


def test_network_tables_and_windows():
    rng = np.random.default_rng(0)
    net = langid.fit([b"aaab" * 200, b"xyzz" * 200] * 20, ["p", "q"] * 20)
    x = rng.integers(0, 64, (3, 256)).astype(np.uint8)
    pooled, _ = net.pooled(x[:, :])
    # merged tables leave out the last places of the narrower filters
    assert net.probabilities(x).shape == (3, 2) and pooled.shape == (3, 24)
    got = net.predict(pa.array(["aaab" * 90, "xyzz" * 3000, None, "", "123 ...", "é"])).to_pylist()
    assert [g["lang"] for g in got[:2]] == ["p", "q"] and [g["lang"] for g in got[2:5]] == ["und"] * 3
    assert got[5]["lang"] in ("p", "q") and all(0 <= g["score"] <= 1 for g in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None), (None, "b", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"] * 3
    assert langid.identify(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = langid.identify(docs).selectExpr("row.lang", "held_out", "lang_pred", "score").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
