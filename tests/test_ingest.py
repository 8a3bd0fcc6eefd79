"""Golden rows worked by hand, and properties of the splitter and the carried context."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafquery.operators import chunks as C, sections as S
from leafquery.plans.ingest import chunks_of_pages, sections_of_pages
from leafquery.sources.pages import PAGE_SCHEMA, assemble_markdown, parse_excluded_pages, split_pages
from leafquery.sources.tables import export_chunks, read_chunks, replace_level


def sections_of(spark, block):
    df = spark.createDataFrame([(1, block)], "id long, text string")
    return [r.text for r in S.split_heading_sections(df).orderBy("sec_seq").collect()]


def test_text_before_the_first_heading_is_lost(spark):
    assert sections_of(spark, "lost\n# A\nx\n## B\ny") == ["# A\nx", "## B\ny"]
    assert sections_of(spark, "no heading\nat all") == ["no heading\nat all"]
    # a mark and its title may be on different lines
    assert sections_of(spark, "a\n##\n\nfoo\nbar") == ["##\n\nfoo\nbar"]
    assert sections_of(spark, "####### seven\nx") == ["####### seven\nx"]


def page(doc, no, text, level="undergraduate"):
    return doc, level, 2026, no, text


def test_context_sees_later_matches_of_its_block_and_persists(spark):
    rows = [page(1, 1, "# Intro\nhello\n# Department of Physics\nx"), page(1, 2, "plain"),
            page(1, 3, "Faculty of Arts *\nSchool of Law\ntext"), page(1, 4, "Department of   \nnext"), page(1, 5, "end")]
    pages = spark.createDataFrame(rows, PAGE_SCHEMA)
    out = sections_of_pages(pages).orderBy("page_seq", "sec_seq").collect()
    got = [(r.page, r.heading_leaf, r.faculty, r.department) for r in out]
    assert got == [
        (1, "Page 1", None, "Physics"),          # the block scan already saw the later heading
        (1, "Intro", None, "Physics"),
        (1, "Department of Physics", None, "Physics"),
        (2, "Page 2", None, "Physics"),
        (3, "Page 3", "Arts ", "Physics"),       # first match; marks are stripped after blanks
        (4, "Page 4", "Arts ", "next"),          # white space may run over the line end
        (5, "Page 5", "Arts ", "next"),
    ]


def test_empty_capture_is_a_value(spark):
    df = spark.createDataFrame([("Department of *\nx",), ("Department of x",), ("none",)], "text string")
    got = [r.department for r in S.scan_context(df).collect()]
    assert got == ["", "x", None]


@pytest.mark.parametrize("pages_per_segment", [1, 2, 1000])
def test_carried_context_does_not_depend_on_segments(spark, pages_per_segment):
    rows = [page(d, n, f"Department of D{n}" if n % 4 == d % 4 else f"text {n}") for d in range(3) for n in range(1, 12)]
    blocks = spark.createDataFrame(rows, PAGE_SCHEMA).withColumnRenamed("page_no", "page_seq")
    out = S.carry_context(blocks.repartition(5), pages_per_segment=pages_per_segment)
    got = {(r.doc_id, r.page_seq): r.department for r in out.collect()}
    for d in range(3):
        last = None
        for n in range(1, 12):
            last = f"D{n}" if n % 4 == d % 4 else last
            assert got[d, n] == last


def test_rows_of_one_section(spark):
    text = ("Dean Dr. Alice Smith\nLecturer Bob Jones\n"
            "CS-101 | Some long title | 3-0-3\nEE 202 | Other long title | 2-1-3\n"
            "Tuition fee Rs. 1,200\nHostel charges PKR 300")
    df = spark.createDataFrame([(text,)], "text string").select(
        S.extract_course_rows(F.col("text")).alias("c"), S.extract_fee_rows(F.col("text")).alias("f"),
        S.extract_faculty_rows(F.col("text")).alias("p"))
    row = df.first()
    # the first lazy gap takes one character and so does the title
    assert [(c.course_code, c.course_title, c.credit_hours) for c in row.c] == [
        ("CS-101", "|", "3-0-3"), ("EE 202", "|", "2-1-3")]
    assert [(f.fee_type, f.amount) for f in row.f] == [("Tuition fee ", "1,200"), ("Hostel charges ", "300")]
    # letters, dots and white space run on for up to 41 characters
    assert [p.designation for p in row.p] == ["Dean"]
    assert row.p[0].person_name.startswith("Dr. Alice Smith\nLecturer Bob Jones")


def parts_of(spark, text):
    df = spark.createDataFrame([(text, "parent")], "text string, heading_path string")
    return [(r.h1, r.h2, r.h3, r.h4, r.heading_path, r.text)
            for r in C.split_by_headers(df).orderBy("header_seq").collect()]


def test_headers_nest_and_reset(spark):
    text = "# A\na\n## B\nb\n### C\nc\n#### D\nd\n## E\n\ne1\n  e2  \n# F\nf"
    assert parts_of(spark, text) == [
        ("A", None, None, None, "A", "# A\na"),
        ("A", "B", None, None, "A > B", "## B\nb"),
        ("A", "B", "C", None, "A > B > C", "### C\nc"),
        ("A", "B", "C", "D", "A > B > C > D", "#### D\nd"),
        ("A", "E", None, None, "A > E", "## E  \ne1\ne2"),
        ("F", None, None, None, "F", "# F\nf"),
    ]


def test_bare_header_joins_the_deeper_part(spark):
    assert parts_of(spark, "# A\n## B\nb") == [("A", "B", None, None, "A > B", "# A  \n## B\nb")]
    assert parts_of(spark, "only\n\n\ntext") == [(None, None, None, None, "parent", "only  \ntext")]
    assert parts_of(spark, "##### five\nx")[0][:5] == (None, None, None, None, "parent")


def test_split_uses_the_first_separator_that_occurs():
    assert C.split_prose("aaaa\n\nbbbb\n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert C.split_prose("aaaa\nbbbb\ncccc", 9, 0) == ["aaaa\nbbbb", "cccc"]
    assert C.split_prose("aaa. bbb. ccc", 8, 0) == ["aaa. bbb", ". ccc"]
    assert C.split_prose("aaaa bbbb cccc", 9, 0) == ["aaaa bbbb", "cccc"]
    assert C.split_prose("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]
    assert C.split_prose("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert C.split_prose("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_are_bounded_and_cover_the_text(text, size, overlap):
    pieces = C.split_prose(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    kept = "".join("".join(p.split()) for p in pieces)
    assert len(kept) >= len("".join(text.split()))
    at = 0
    for p in pieces:  # pieces come in text order
        found = text.find(p, max(0, at - overlap - 2))
        assert found >= 0
        at = found + len(p)


def test_tables_stay_whole_and_sizes_hold(spark):
    rows = [page(1, 1, "| a | b |\n" * 900), page(1, 2, "# Title\n" + "word " * 2000)]
    chunks = chunks_of_pages(spark.createDataFrame(rows, PAGE_SCHEMA)).collect()
    tables = [c for c in chunks if "|" in c.text]
    assert len(tables) == 1 and tables[0].chunk_size > 8000 and tables[0].chunk_index == 0
    assert all(c.chunk_size == len(c.text) for c in chunks)
    assert all(c.chunk_size <= 2000 for c in chunks if "|" not in c.text)


def test_parts_of_a_long_document_equal_the_whole(spark):
    pages = spark.createDataFrame([page(1, n, f"text {n}") for n in range(1, 8)], PAGE_SCHEMA)
    whole = assemble_markdown(pages).collect()
    parts = assemble_markdown(pages, pages_per_part=3).orderBy("part_no").collect()
    assert len(whole) == 1 and len(parts) == 3
    assert "\n\n".join(p.text for p in parts) == whole[0].text


def test_context_carried_over_parts_equals_page_by_page(spark):
    from leafquery.operators.sections import carry_context, split_page_blocks

    texts = ["# Department of D1\na", "b", "c", "# Department of D4\nd", "e", "# Department of D6\nf", "g"]
    pages = spark.createDataFrame([page(1, n, t) for n, t in enumerate(texts, 1)], PAGE_SCHEMA)

    def carried(per_part):
        out = carry_context(split_page_blocks(assemble_markdown(pages, pages_per_part=per_part)))
        return sorted((r.page, r.department, r.text) for r in out.collect())

    assert carried(3) == carried(1) == carried(100)
    assert sorted({(p_, d) for p_, d, _ in carried(3)}) == [(1, "D1"), (2, "D1"), (3, "D1"), (4, "D4"), (5, "D4"), (6, "D6"), (7, "D6")]


def test_excluded_pages(spark):
    spec = spark.createDataFrame([(" 2, ,5 ", "undergraduate"), ("1", "postgraduate")], "s string, l string")
    assert [r[0] for r in spec.select(parse_excluded_pages(F.col("s"), F.col("l"))).collect()] == [[2, 5], []]
    bad = spark.createDataFrame([("2,x", "undergraduate")], "s string, l string")
    with pytest.raises(Exception):
        bad.select(parse_excluded_pages(F.col("s"), F.col("l"))).collect()
    pages = spark.createDataFrame([page(1, n, f"p{n}") for n in range(1, 7)], PAGE_SCHEMA)
    listed = spark.createDataFrame([("undergraduate", [2, 5, 5, 99])], "academic_level string, excluded_pages array<int>")
    main, seat = split_pages(pages, listed)
    assert sorted((r.page_no, r.text) for r in main.collect()) == [(1, "p1"), (2, "p3"), (3, "p4"), (4, "p6")]
    assert sorted(r.text for r in seat.collect()) == ["p2", "p5"]


def test_replacing_a_level_twice_is_replacing_it_once(spark, tmp_path):
    path = str(tmp_path / "chunks")
    pages = spark.createDataFrame([page(1, 1, "ug text"), page(2, 1, "pg text", "postgraduate")], PAGE_SCHEMA)
    chunks = chunks_of_pages(pages)
    replace_level(chunks, path)
    new = chunks_of_pages(spark.createDataFrame([page(3, 1, "new ug"), page(3, 2, "more")], PAGE_SCHEMA))
    for _ in range(2):
        replace_level(new, path)
        got = sorted((r.academic_level, r.text) for r in read_chunks(spark, path).collect())
        assert got == [("postgraduate", "## Page 1  \npg text"), ("undergraduate", "## Page 1  \nnew ug"),
                       ("undergraduate", "## Page 2  \nmore")]


def test_chunks_survive_a_json_round_trip(spark, tmp_path):
    rows = [page(1, 1, "# Fees\nTuition fee Rs. 1,200\n| CS-101 | Title of course | 3-0-3 |")]
    chunks = chunks_of_pages(spark.createDataFrame(rows, PAGE_SCHEMA))
    export_chunks(chunks, str(tmp_path / "json"), "json")
    back = read_chunks(spark, str(tmp_path / "json"), "json")
    key = lambda r: r["chunk_id"]
    assert sorted((r.asDict(True) for r in back.collect()), key=key) == sorted(
        (r.asDict(True) for r in chunks.collect()), key=key)
    assert read_chunks(spark, str(tmp_path / "absent")).count() == 0


def test_equal_texts_of_two_documents_are_two_chunks(spark):
    from leafquery.operators.bm25 import searchable
    from leafquery.plans.ingest import build_corpus, chunks_of_pages
    from leafquery.sources.pages import PAGE_SCHEMA

    same = "a long beginning " * 20
    rows = [(d, "undergraduate", 2026, 1, f"{same}{end}") for d, end in ((1, "x"), (2, "x"), (3, "y"))]
    chunks = chunks_of_pages(spark.createDataFrame(rows, PAGE_SCHEMA), staged=False)
    assert chunks.count() == 3 == chunks.select("chunk_id").distinct().count()
    assert build_corpus(chunks).chunks.count() == searchable(chunks).count() == 3
    short = chunks_of_pages(spark.createDataFrame(rows, PAGE_SCHEMA), staged=False, short_ids=True)
    assert short.select("chunk_id").distinct().count() == 1


def test_long_page_mark_gives_no_page(spark):
    from leafquery.operators.sections import carry_context

    blocks = spark.createDataFrame([(1, "undergraduate", 2026, 1, "## Page 20260101123456\n\ntext")],
                                   "doc_id long, academic_level string, year int, page_seq int, text string")
    assert [r.page for r in carry_context(blocks).collect()] == [None]


def test_shared_folder_is_wanted_off_local_masters(monkeypatch):
    import types

    import pytest

    from leafquery.functions.staging import shared_folder

    class Spark:
        sparkContext = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
        conf = types.SimpleNamespace(get=lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Spark())


def test_fenced_code_has_no_headers(spark):
    from leafquery.operators.chunks import split_by_headers

    text = "# A\none\n```sh\n# no header\n## nor this\n```\n## B\ntwo\n~~~\n# open to the end"
    rows = spark.createDataFrame([(1, text, None), (2, "```\n# x\n```\n# C\nthree", None)], "doc_id long, text string, heading_path string")
    got = sorted((r.doc_id, r.header_seq, r.h1, r.h2, r.text) for r in split_by_headers(rows).collect())
    assert [g[:4] for g in got] == [(1, 0, "A", None), (1, 1, "A", "B"), (2, 0, None, None), (2, 1, "C", None)]
    assert "# no header\n## nor this" in got[0][4] and got[1][4].endswith("# open to the end")
