"""Each stage of the pipeline, on what the one before it kept, against its brute-force version."""

import os

import pyarrow as pa
import pytest

import corpus_pipeline
import test_decontaminate
import test_jaccard
import test_line_dedup
import test_packing
from leafquery.llm import quality

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # repeated, null and empty rows go through all stages
    odd = spark.createDataFrame([(900_000, None, "en", "s", 0), (900_001, "", "en", "s", 0)], docs.schema)
    docs = docs.union(docs.filter("doc_id < 3")).union(odd)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    model = quality.train(docs, labels)
    kept = [docs]
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, kept[-1], SF_DIR).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == docs.columns, name
    given = [rows_of(df) for df in kept[:-1]]

    scores = model.score(quality.features(pa.array([t for _, t in given[0]])).astype(float))
    assert given[1] == [r for r, s in zip(given[0], scores) if s >= 0.5]

    want = [(i, text) for i, _, _, text in test_line_dedup.brute(given[1], 10)]
    assert given[2] == sorted(want, key=str)

    groups = {(d, c) for d, n, c in test_jaccard.brute(given[2]) if n and d != c}
    gone = {d for d, _ in groups}
    alone = [r for r in given[2] if r[0] not in gone]
    # equal rows of one id are one document, but for texts without a word, which link with nothing
    want = sorted({r for r in alone if test_jaccard.shingles(r[1])} | set(), key=str) + [r for r in alone if not test_jaccard.shingles(r[1])]
    assert given[3] == sorted(want, key=str)

    hit = {d for d, _ in test_decontaminate.brute(given[3], items)}
    assert given[4] == [r for r in given[3] if r[0] not in hit]

    packed = [r for r in kept[-1].withColumnRenamed("doc_id", "id").collect()]
    made = test_packing.check(given[4], packed)
    assert made <= 1.03 * -(-sum(r.length for r in packed) // 2048) + 1


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR)
        assert docs.count() == 0, name
