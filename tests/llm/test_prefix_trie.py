import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from leafquery.llm import prefix_trie
from leafquery.llm.prefix_trie import trie_table

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, piece int, `row` int"


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        host = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(host, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(key)))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), children[key], leaves[key], saved[key],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, partitions=3):
    table = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(partitions)
    got = sorted((tuple(r) for r in trie_table(table).collect()), key=str)
    assert got == brute(rows)
    return got


def test_random_conversations_with_nulls_empty_texts_and_negative_ids(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = []
        for _ in range(60):
            c = rng.choice([rng.randint(-250, 450), 100 * rng.randint(0, 4)])
            if any(r[0] == c for r in rows):
                continue
            for t in rng.sample([None, *range(9)], rng.randint(1, 9)):
                rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "é\U0001f600", "", None, "long " * 9])))
        rows += [(None, 1, "user", "no conversation")] * 2
        check(spark, rows)


def test_equal_conversations_share_one_sequence(spark):
    rows = [(1000 * c, t, "user", f"turn {t}") for c in range(30) for t in range(4 if c % 3 else 2)]
    got = check(spark, rows)
    assert len(got) == 5  # the root and one path


def test_repeated_rows_are_turns_of_their_own(spark):
    check(spark, [(5, 1, "user", "same")] * 7 + [(500, 1, "user", "same")] * 7 + [(505, 2, None, None)])


def test_conversation_without_turns(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert check(spark, [(lone, 0, "user", "only")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_empty_table(spark):
    assert check(spark, []) == []


@pytest.fixture
def many_pieces(spark):
    """Ranges of a few rows, so that conversations, end lists and hot nodes lie in several of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_conversation_in_many_pieces_and_long_end_lists(spark, many_pieces, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_CHILDREN", 3)
    rng = random.Random(4)
    rows = [(300, t, "user", rng.choice("ab") * rng.randint(0, 5)) for t in range(500)]
    rows += [(7000 + 100 * c, t, "user", "copy") for c in range(120) for t in range(2)]
    rows += [(90000 + 100 * c, t, "user", f"{t} {c if t else 0}") for c in range(60) for t in range(3)]
    rows += [(c, t, "user", "own") for c in range(301, 340) for t in range(8)]
    check(spark, rows)
