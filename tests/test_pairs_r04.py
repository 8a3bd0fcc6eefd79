"""pairs of known tokens are counted as numbers; the counts are those of the strings."""
import random
from collections import Counter

import pytest

from leafquery.operators import trained as TR


@pytest.mark.parametrize("held, pairs", [(1 << 18, 1 << 22), (7, 20)])
def test_numbered_pairs_are_the_pairs_of_strings(spark, monkeypatch, held, pairs):
    """Before, every pair was a row of two strings until it was summed."""
    rng = random.Random(9)
    words = ["b", "a", "ä", "z", "日本", "a1", "rare", "\U0001f600x", "￮q"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(50)] + [None, "", "a", "a a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    known = spark.createDataFrame([(w,) for w in [*words[:6], "x", "￮q", "never", "a"]], "token string")
    want = Counter()
    kept = {r.token for r in known.collect()}
    for (tokens,) in df.select(TR.tokenize(df.text)).collect():
        for i, x in enumerate(tokens or []):
            for y in tokens[i + 1:i + 4]:
                if x in kept and y in kept:
                    want[min(x, y), max(x, y)] += 1

    def rows(counts):
        found = [((r.x, r.y), r.n) for r in counts.collect()]
        assert len(found) == len(dict(found))
        return dict(found)

    run = TR._numbered_pairs

    monkeypatch.setattr(TR, "_numbered_pairs", lambda batches, few, window: run(batches, few, window, held, pairs))
    counts = TR.pair_counts(df, window=3, known=known)
    assert "MapInArrow" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert rows(counts) == want and len(want) > 20
    monkeypatch.setattr(TR, "BROADCAST_TOKENS", 2)
    assert rows(TR.pair_counts(df, window=3, known=known)) == want
