import os
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from leafquery.llm.boundaries import EliasFano, ShardReader, read_ids, write_ids

from test_packing import ODD

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 1 << 20), st.integers(0, (1 << 63) - 1)), max_size=1500))
def test_sequences_come_back_and_every_value_is_found(values):
    values = sorted(values)
    data = b"before" + EliasFano.build(np.array(values, np.uint64)).tobytes()
    ef, end = EliasFano.frombytes(data, 6)
    assert end == len(data) and ef.values().tolist() == values
    places = list(range(0, len(values), 7)) + [len(values) - 1] * bool(values)
    assert [ef.select(i) for i in places] == [values[i] for i in places]


def test_boundaries_are_nearly_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    assert 8 * len(EliasFano.build(ends).tobytes()) < 20_000 * (2.5 + np.log2(1000))


def wanted(rows):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codes = [e.ids + [2] for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]
    return [(i, c, zlib.crc32(np.array(c, "<u4").tobytes())) for (i, _), c in zip(rows, codes)]


def check(rows, got):
    want = wanted(rows)
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(c), crc) for i, c, crc in want)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or (r.id is not None and r.id >= last))
        at, last = at + r.n_tokens, r.id


def test_odd_texts_null_ids_and_repeated_rows(docs_of):
    rows = [(7 * i - 20, t) for i, t in enumerate(ODD)] + [(1, ODD[3])] * 5 + [(None, "null id"), (None, None), (-(1 << 63), "x"), ((1 << 63) - 1, "y")]
    docs = docs_of(rows).repartition(5)
    check(rows, read_ids(write_ids(docs)).collect())
    manifest = write_ids(docs, shard_ids=1000)  # many files to a range
    files = manifest.orderBy("start").collect()
    assert len(files) > 5 and [f.start for f in files] == np.cumsum([0, *[f.n_ids for f in files]])[:-1].tolist()
    got = read_ids(manifest, with_ids=True).collect()
    check(rows, got)
    assert Counter((r.id, tuple(r.ids)) for r in got) == Counter((i, tuple(c)) for i, c, _ in wanted(rows))
    for f in files:
        reader = ShardReader(f.path)
        assert (reader.doc_id(0), reader.doc_id(reader.n_docs - 1)) == (f.first_id, f.last_id)
        for r in got:
            if f.start <= r.start < f.start + f.n_ids:
                at = [i for i in range(reader.n_docs) if reader.span(i)[0] == r.start - f.start][0]
                assert reader.doc_id(at) == r.id and reader.ids(at).tolist() == list(r.ids)
                assert r.id is None or at in reader.find(r.id)


def test_empty_table(docs_of):
    manifest = write_ids(docs_of([]))
    assert manifest.count() == 0 and read_ids(manifest).count() == 0


def test_text_beyond_one_slice(docs_of):
    rows = [(1, "a few words, " * 200_000), (0, "b"), (2, None)]
    check(rows, read_ids(write_ids(docs_of(rows))).collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], read_ids(write_ids(docs, shard_ids=50_000)).collect())
