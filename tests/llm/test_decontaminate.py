import random
import re
from itertools import combinations

from leafquery.llm.decontaminate import MASKS, decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = set()
    for d, text in docs:
        doc = words(text)
        for i, item in items:
            own = words(item)
            if len(own) < 5:
                continue
            w = min(20, len(own))
            need = w if len(own) < 8 else -(-4 * w // 5)
            for shift in range(-len(own) + 1, len(doc)):
                equal = [0 <= shift + j < len(doc) and doc[shift + j] == own[j] for j in range(len(own))]
                if any(sum(equal[a:a + w]) >= need for a in range(len(own) - w + 1)):
                    out.add((d, i))
    return out


def found(docs, items):
    rows = decontaminate(docs, items).selectExpr("row.doc_id", "explode(hits) h").collect()
    assert all(0 <= r.h.n_equal <= r.h.n_words for r in rows)
    return [(r.doc_id, r.h.item_id) for r in rows]


def test_masks_miss_no_allowed_substitutions():
    for n in range(8, 21):
        for bad in combinations(range(n), n // 5):
            assert any(all(m != "1" or o + j not in bad for j, m in enumerate(mask))
                       for mask in MASKS for o in range(n - len(mask) + 1)), (n, bad)


def test_equals_brute_force_with_substitutions_cut_ends_and_odd_rows(spark, docs_of):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([3, 5, 6, 7, 8, 9, 14, 19, 20, 21, 40, 57])]
    items += [(50, None), (51, ""), (52, items[-1][1]), (None, items[6][1])]
    docs = [(900, None), (901, ""), (902, items[10][1].upper()), (902, items[10][1].upper())]
    for n in range(120):
        own = words(rng.choice(items)[1])
        for k in rng.sample(range(len(own)), min(len(own), rng.randint(0, 6))):
            own[k] = rng.choice(vocab)
        own = own[rng.choice([0, 0, rng.randint(0, 12)]):]
        docs.append((n, " ".join(rng.choices(vocab, k=rng.randint(0, 30)) + own + rng.choices(vocab, k=rng.randint(0, 9)))))
    docs.append((990, "filler " * 20000 + items[11][1]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = found(docs_of(docs), benchmark)
    assert set(got) == brute(docs, items)
    assert got.count((902, 10)) == 2
    # several small blocks of the benchmark find the same
    split = decontaminate(docs_of(docs), benchmark, block_bytes=500).selectExpr("row.doc_id", "explode(hits) h").collect()
    assert sorted((r.doc_id, r.h.item_id or -1) for r in split) == sorted((d, i or -1) for d, i in got)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(docs_of([(1, "a b c d e")]), none) == []
    assert decontaminate(docs_of([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
