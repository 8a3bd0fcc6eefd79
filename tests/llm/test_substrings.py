import os
import random
from collections import Counter

import numpy as np
import pytest

from leafquery.llm.substrings import minimizers, multikey_sort, remove_repeats

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p + 1:p + 1 + length] = True
        turns = np.flatnonzero(gone[1:] != gone[:-1])
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), tuple(zip(turns[::2].tolist(), turns[1::2].tolist())), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def mixed(seed, n=60, size=120):
    """Copies, passages between different neighbours, self-overlaps and small changes."""
    rng = random.Random(seed)
    letters = "abé \n\x00"
    pool = ["".join(rng.choices(letters, k=rng.randint(10, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            rows.append((i, rng.choice(rows)[1]))
        elif kind < 0.3:
            rows.append((i, rng.choice(["ab", "a", "aab\n"]) * rng.randint(1, size)))
        else:
            rows.append((i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(1, 40)))
                                    for _ in range(rng.randint(0, 6)))))
    return rows


CASES = [(1, None), (2, ""), (3, "short"), (4, "abc" * 20), (4, "abc" * 20), (None, "é" * 30), (5, "é" * 30 + "x"), (6, "unique text " + "0123456789" * 2), (7, ""), (8, "q" * 40000)]


@pytest.mark.parametrize("length", [16, 30])
def test_cases_of_nulls_ties_and_repeats(docs_of, length):
    assert got(remove_repeats(docs_of(CASES), length)) == brute(CASES, length)


def test_no_rows(docs_of):
    assert remove_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_mixed_texts_over_many_small_buckets(docs_of_any, seed):
    rows = mixed(seed)
    assert got(remove_repeats(docs_of_any(rows), 24, bucket_rows=15)) == brute(rows, 24)


def test_one_passage_with_different_neighbours_crosses_every_boundary(docs_of_any):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=45))
    rows = [(i, "".join(rng.choices("xyz", k=30)) + passage + "".join(rng.choices("uvw", k=30))) for i in range(80)]
    rows += [(100 + i, "".join(rng.choices("xyz", k=30)) + passage[:20] + "".join(rng.choices("uvw", k=30))) for i in range(40)]
    assert got(remove_repeats(docs_of_any(rows), 24, bucket_rows=10)) == brute(rows, 24)


def test_minimizer_depends_on_the_string_alone():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 400).astype(np.uint8)
    both = np.concatenate([text, text[37:300]])
    at = minimizers(both, np.array([0, 400, 663]), 20)
    assert (at[400:400 + 244] - 400 == at[37:37 + 244] - 37).all()
    assert (at[381:400] == -1).all() and (at[644:] == -1).all()


def test_multikey_sort_is_the_byte_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 21)).astype(np.uint8)
    order = multikey_sort(rows)
    assert [bytes(rows[k]) for k in order] == sorted(map(bytes, rows))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(remove_repeats(docs, 200, bucket_rows=100)) == brute(rows, 200)
