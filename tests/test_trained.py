"""The trained encoder against numpy's decomposition, and on questions that share no word with their chunk."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from leafquery.operators import trained as TR


def topic_texts(rng, topics, n):
    """Texts of 20 words from one of some topics of 30 words each, with common words between."""
    common = [f"common{i}" for i in range(8)]
    rows = []
    for i in range(n):
        t = i % topics
        rows.append((i, t, " ".join(rng.choice(common) if rng.random() < 0.3 else f"t{t}word{rng.randint(0, 29)}" for _ in range(20))))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    rows = topic_texts(random.Random(2), 6, 400) + [(9000, 0, None), (9001, 0, "")]
    return rows, spark.createDataFrame(rows, "chunk_id long, topic int, text string").repartition(3)


def dense(rows, window, least):
    texts = [t.split() for _, _, t in rows if t]
    n = Counter(w for t in texts for w in t)
    names = sorted(w for w, c in n.items() if c >= least)
    at = {w: i for i, w in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for t in texts:
        for i, x in enumerate(t):
            for y in t[i + 1:i + 1 + window]:
                if x in at and y in at:
                    m[at[x], at[y]] += 1
                    m[at[y], at[x]] += 1
    s, total = m.sum(1), m.sum()
    out = np.zeros_like(m)
    for i, j in zip(*np.nonzero(m)):
        out[i, j] = max(0.0, math.log(m[i, j] * total / (s[i] * s[j])))
    return names, out


def test_matrix_and_space_equal_numpy(corpus):
    rows, texts = corpus
    tokens, cells = TR.information(texts, window=3, least=4)
    names, want = dense(rows, 3, 4)
    at = {w: i for i, w in enumerate(names)}
    got = np.zeros_like(want)
    for r in cells.collect():
        got[at[r.i], at[r.j]] += r.v
    assert np.allclose(got, want) and tokens.count() == len(names)
    space, values = TR.leading_space(cells, tokens, 5, steps=12)
    true_values, true_vectors = np.linalg.eigh(want)
    best = np.argsort(-true_values)[:5]
    assert np.allclose(values, true_values[best], rtol=1e-3)
    q = np.zeros((len(names), 5))
    for r in space.collect():
        q[at[r.token]] = r[1:]
    # the same space: both projections agree
    assert np.allclose(q.T @ q, np.eye(5), atol=1e-6)
    assert np.abs(q @ q.T - true_vectors[:, best] @ true_vectors[:, best].T).max() < 0.02


@pytest.mark.parametrize("broadcast_bytes", [TR.BROADCAST_BYTES, 9000])
def test_held_out_questions_rank_their_topic_above_others(spark, corpus, monkeypatch, tmp_path, broadcast_bytes):
    monkeypatch.setattr(TR, "BROADCAST_BYTES", broadcast_bytes)
    _, texts = corpus
    TR.train(texts, dimension=8, least=4).write(f"{tmp_path}/tokens", 3)
    model = TR.TokenVectors.read(spark, f"{tmp_path}/tokens")
    assert model.width == 8
    rng = random.Random(7)
    sides = []
    for side, (a, b) in enumerate([(0, 14), (15, 29)]):  # questions and chunks share no word
        sides += [(100 * side + t, f"{side}", " ".join(f"t{t}word{rng.randint(a, b)}" for _ in range(12))) for t in range(6)]
    sides += [(900, "x", None), (901, "x", "unknown words only")]
    out = {r.chunk_id: np.array(r.vec) for r in TR.embed_trained(
        spark.createDataFrame(sides, "chunk_id long, side string, text string"), model).collect()}
    assert not out[900].any() and not out[901].any() and len(out) == 14
    for t in range(6):
        sims = [float(out[t] @ out[100 + u]) for u in range(6)]
        assert abs(np.linalg.norm(out[t]) - 1) < 1e-5 and int(np.argmax(sims)) == t and sims[t] > 0.5


def test_no_texts(spark):
    model = TR.train(spark.createDataFrame([], "text string"), dimension=4)
    asked = spark.createDataFrame([(1, "any words")], "chunk_id long, text string")
    assert TR.embed_trained(asked, model).collect()[0].vec == [0.0] * 4
