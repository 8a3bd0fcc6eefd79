import os
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

import numpy as np

from leafquery.llm import jaccard
from leafquery.llm.jaccard import jaccard_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(n, seed, words=60):
    """Chains of texts, each a few words off the one before, and texts that share one passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=30)
    rows, text = [], rng.choices(vocab, k=words)
    for i in range(n):
        kind = rng.random()
        if kind < 0.15:
            text = rng.choices(vocab, k=rng.randint(1, words))
        elif kind < 0.75:
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            text += rng.choices(vocab, k=rng.randint(0, 2))
        else:
            rows.append((1000 + i, " ".join(passage + rng.choices(vocab, k=rng.randint(0, 12)))))
            continue
        rows.append((i, " ".join(text)))
    return rows


CASES = [(5, None), (6, ""), (7, " \n"), (9, "A b"), (8, "a  B"), (4, "a b c"), (4, "a b c"), (4, "other text of five words"), (None, "A B C"),
         (None, "alone among all these rows here"), (3, "x " * 9000), (2, "X " * 700), (10, "x"), (11, "x x x x"), (12, "x x x x x")]


def test_cases_of_nulls_ties_and_repeats(docs_of):
    assert got(jaccard_components(docs_of(CASES))) == brute(CASES)


def test_no_rows(docs_of):
    assert jaccard_components(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_near_copies_equal_brute_force(docs_of_any, seed):
    rows = near_copies(150, seed)
    assert got(jaccard_components(docs_of_any(rows))) == brute(rows)


def test_short_sets_that_differ_by_one_shingle(docs_of_any):
    base = "one two three four five six seven eight nine ten"
    rows = [(i, f"{base} end{i}") for i in range(40)] + [(99, base), (100, base + " end3 more")]
    assert got(jaccard_components(docs_of_any(rows))) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(jaccard_components(docs)) == brute(rows)


@pytest.mark.parametrize("cell", [2, 7])
def test_lists_longer_than_a_cell_equal_brute_force(docs_of_any, cell):
    rows = near_copies(90, 11)
    assert got(jaccard_components(docs_of_any(rows), cell=cell)) == brute(rows)


def viable_pairs(rows, share):
    """Pairs of one list that size and position allow, one by one."""
    out = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (n1, p1, s1), (n2, p2, s2) = sorted([rows[a], rows[b]])
            most = 1 + min(n1 - p1 - 1, n2 - p2 - 1)
            if share * n2 <= 100 * n1 and (100 + share) * most >= share * (n1 + n2):
                out.add(frozenset((s1, s2)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 11)), min_size=2, max_size=40))
def test_blocks_give_every_pair_that_position_allows(sizes):
    rows = sorted((n, min(p, n - 1), k) for k, (n, p) in enumerate(sizes))
    n, p, sid = (np.array(c) for c in zip(*rows))
    whole = [frozenset((int(sid[i]), int(x))) for i, j in jaccard._pairs_of_list(n, p, np.zeros(len(n)), 80) for x in sid[j]]
    assert len(whole) == len(set(whole)) and set(whole) == viable_pairs(rows, 80)
    part = sid % 2
    across = {frozenset((int(sid[i]), int(x))) for i, j in jaccard._pairs_of_list(n, p, part, 80) for x in sid[j]}
    assert across == ({q for q in whole if len({x % 2 for x in q}) == 2} if len(set(part)) == 2 else set(whole))


@pytest.mark.parametrize("cell", [3, 10])
def test_cells_hold_every_pair_once_and_bound_what_a_group_holds(spark, cell):
    rng = random.Random(cell)
    rows = [(n, rng.randrange(max(1, n // 4)), k) for k in range(300) for n in [rng.choice([20, 20, 20, 21, 30, 60])]]
    index = spark.createDataFrame([(7, *r) for r in rows] + [(8, 20, 0, 1), (8, 20, 1, 2)],
                                  "shingle long, n long, p long, sid long")
    groups = {}
    for r in jaccard._cells(index, 80, cell).collect():
        groups.setdefault((r.shingle, r.x, r.y), []).append((r.n, r.p, r.sid, r.part))
    found = []
    for key, own in groups.items():
        n, p, sid, part = (np.array(c) for c in zip(*sorted(own)))
        if key[0] == 7 and key[1] != key[2] and len(set(part.tolist())) == 1:
            continue
        found += [frozenset((int(sid[i]), int(x))) for i, j in jaccard._pairs_of_list(n, p, part, 80) for x in sid[j] if key[0] == 7]
    assert len(found) == len(set(found)) and set(found) == viable_pairs(sorted(rows), 80)
    assert max(map(len, groups.values())) <= 8 * cell < len(rows)
    slices = max(y for _, _, y in groups)
    assert len(groups) < (slices + 1) * (slices + 2) / 2  # some pairs of slices are skipped whole


def test_counts_sent_grow_with_shingles_not_with_ranges():
    """A document without a shingle in a range costs no byte there."""
    doc = np.array([3, 3, 900, 70_000])
    who, n = jaccard._unsparse(jaccard._sparse(*np.unique(doc, return_counts=True)))
    assert who.tolist() == [3, 900, 70_000] and n.tolist() == [2, 1, 1]
    rng = np.random.default_rng(0)
    sent = {}
    for ranges in (64, 1024):
        part, own = rng.integers(0, ranges, 20_000), rng.integers(0, 600, 20_000)
        sent[ranges] = sum(len(jaccard._sparse(*np.unique(own[part == r], return_counts=True))) for r in range(ranges))
    assert max(sent.values()) <= 4 * 20_000 + 1024


@pytest.mark.parametrize("ranges", [1, 300])
def test_shared_counts_for_any_number_of_ranges(docs_of_any, ranges):
    rows = near_copies(60, 5)
    sets = [shingles(t) for _, t in rows]
    want = sorted((d, len(s), sum(any(g in o for j, o in enumerate(sets) if j != i) for g in s))
                  for i, ((d, _), s) in enumerate(zip(rows, sets)))
    docs = jaccard.keyed(docs_of_any(rows), "doc_id", "text").select("id", "text", "key")
    assert sorted((r.key.id, r.n, r.shared) for r in jaccard._shared_counts(docs, ranges, 5).collect()) == want


def test_a_text_beyond_one_chunk(docs_of_any):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(260_000)]
    near = words[:]
    for k in range(5, len(near), 200):
        near[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:4])), (4, " ".join(words[:130_000]))]
    assert len(rows[0][1]) > jaccard._CHUNK
    assert got(jaccard_components(docs_of_any(rows))) == brute(rows)
