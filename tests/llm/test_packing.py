import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafquery.llm.packing import BestFit, pack_documents, sequences

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.001"


def true_ids(texts):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_random_strings_with_the_literal_and_odd_white_space():
    from leafquery.llm.tokens import encoder

    rng = random.Random(5)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "a", "Bc", "'s", "12", "!", "\u00e9", "\u4e2d", "\U0001f600", "\u0120"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)]
    got = encoder(None).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() + [0] for g in got] == true_ids(texts)


ODD = ["", None, " ", "  a", "a  b", "a \n b", "it's  we'll", "x" * 9000, "a b c " * 3000, " x y z", "é à\tü",
       "<|endoftext|> a <|endoftext|>", "a\x1cb c\x85 d", "12 345 6,7 ...", "a b", "a b"]


def check(rows, packed, capacity=2048):
    want = Counter()
    for (doc_id, _), ids in zip(rows, true_ids([t for _, t in rows])):
        cut = len(ids) % capacity or capacity
        bounds = [0, *range(cut, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_odd_texts_and_repeated_rows(docs_of):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "null id")]
    check(rows, pack_documents(docs_of(rows)).collect())


def test_empty_table(docs_of):
    assert pack_documents(docs_of([])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_real_documents_are_packed_tightly(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    packed = pack_documents(docs).collect()
    made = check(rows, packed)
    assert made <= 1.03 * -(-sum(r.length for r in packed) // 2048) + 1


def test_sequences_hold_the_ids_of_their_pieces(docs_of):
    rows = [(i, "word " * random.Random(i).randint(0, 4000)) for i in range(20)]
    packed = pack_documents(docs_of(rows), with_ids=True)
    got = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        assert list(got[r.sequence_id][r.offset:r.offset + r.length]) == list(r.ids)


def test_bounded_bins_close_the_fullest():
    fit = BestFit(10, 2)
    assert [fit.put(n) for n in (7, 6, 5)] == [(0, 0), (1, 0), (2, 0)]  # bin 0, the fullest, is closed
    assert fit.put(3) == (1, 6)
    assert fit.put(5) == (2, 5)
    assert fit.open == 1
