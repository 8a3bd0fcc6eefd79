from collections import defaultdict

from hypothesis import given, settings, strategies as st

from leafquery.llm.line_dedup import dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    found = defaultdict(set)
    for n, (_, lines) in enumerate(split):
        for line in lines:
            found[key(line)].add(n)
    gone = {k for k, v in found.items() if k and len(v) >= min_docs}
    return sorted(((i, len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone))
                   for i, ls in split), key=str)


def got(df):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


CASES = [(1, None), (2, ""), (3, "A\nb\n\nA "), (4, " a\nÉ\né"), (4, " a\nÉ\né"), (5, "a \nx"), (6, "É\nB\t"), (None, "b\nlong " + "w" * 9000),
         (7, "\n\n"), (8, "x" * 50000), (9, "a\n" * 3000 + "end")]


def test_cases_of_nulls_ties_and_repeats(docs_of):
    for n in (1, 2, 3):
        assert got(dedup_lines(docs_of(CASES), n)) == brute(CASES, n)


def test_no_rows(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_other_columns_come_back(docs_of):
    row = dedup_lines(docs_of([(1, "a")])).first().row
    assert (row.key, row.row, row.n_lines, row.id) == ("x", "y", 1, "z")


@settings(max_examples=8, deadline=None, database=None)
@given(st.lists(st.lists(st.sampled_from(["a", "A ", "\tb", "B", "", "c d", "é"]), max_size=6), min_size=1, max_size=8))
def test_any_lines(docs_of_any, lines):
    rows = [(i, "\n".join(ls)) for i, ls in enumerate(lines)]
    assert got(dedup_lines(docs_of_any(rows), 2)) == brute(rows, 2)
