import os

import numpy as np
import pyarrow as pa
import pytest

from leafquery.llm.quality import FEATURES, features, fit, score_quality, train

SF_DIR = "/root/testdata/sf0.01"


def test_features_by_hand():
    x = dict(zip(FEATURES, features(pa.array(["AB cd!\nab CD!\n12 #"]))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(6))
    assert x["upper"] == pytest.approx(4 / 18) and x["digits"] == pytest.approx(2 / 18)
    assert x["shouts"] == pytest.approx(2 / 18) and x["line_ends"] == pytest.approx(2 / 18)
    assert x["distinct_words"] == pytest.approx(4 / 6)
    assert x["repeated_lines"] == pytest.approx(1 / 3)
    assert x["symbol_words"] == pytest.approx(3 / 6)
    assert x["repeated_windows"] == 0


def test_repeated_windows_and_no_mixing_of_documents():
    text = "a b c d e f g h "
    once, twice, _ = features(pa.array([text, text * 2, text]))[:, FEATURES.index("repeated_windows")]
    assert once == 0 and twice == pytest.approx(2 / 16)


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x, y).score(x) >= 0.5) == y).mean() > 0.95
    assert ((fit(x, (x[:, 2] > 0.3).astype(float)).score(x) >= 0.5) == (x[:, 2] > 0.3)).mean() > 0.98


def test_without_labels_or_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b " * 50000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score_quality(docs, none).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    one = spark.createDataFrame([(3, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 < r.score < 1 for r in score_quality(docs, one).collect())
    assert score_quality(docs_of([]), one).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_held_out_labels_are_met(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels).selectExpr("row.doc_id", "held_out", "score").join(labels, "doc_id")
    rows = out.filter("held_out").collect()
    assert len(rows) > 80
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.93
