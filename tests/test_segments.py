"""The segmented index against a full rebuild after every change."""

import random

import pytest
from pyspark.sql import functions as F

from leafquery.operators.bm25 import bm25_index, bm25_search
from leafquery.operators.segments import SegmentedIndex
from leafquery.operators.vocab import all_aliases, keyword_vocab
from leafquery.streaming import streams as SS

SCHEMA = ("academic_level string, chunk_id string, text string, department string, designation string, faculty string, "
          "program string, section string, course_codes array<string>, commit string, slot string")
WORDS = ["fee", "course", "lab", "admission", "hostel", "exam", "grade", "credit"]


def chunk(rng, level, i):
    """Names change with each version; columns named like those of the index are ignored."""
    text = rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))])
    return (level, f"{i}", text, rng.choice([None, "Department of Physics", " Dept of Law ", "Chemistry Department"]),
            rng.choice([None, "Professor", "Lecturer in Charge"]), rng.choice([None, "Faculty of Science"]),
            rng.choice([None, "BS Physics", "MS Law"]), rng.choice([None, "fee"]), rng.choice([None, ["CS-101"]]), "x", "y")


def rows_of(df, *columns):
    return sorted((tuple(str(v) if not isinstance(v, float) else round(v, 9) for v in r) for r in df.select(*columns).collect()))


def same_as_rebuild(spark, index, live, path):
    """Statistics, postings and vocabularies, by this object and by one that is opened anew."""
    table = spark.createDataFrame([r for rows in live.values() for r in rows], SCHEMA)
    want = bm25_index(table, rows_per_shard=2)
    for have in (index, SegmentedIndex(spark, path, rows_per_shard=2)):
        got = have.index()
        for name, columns in (("corpus", ("academic_level", "n", "avgdl")),
                              ("terms", ("academic_level", "token", "df", "idf", "shards")),
                              ("postings", ("academic_level", "token", "chunk_id", "doc_len", "tf", "department", "course_codes"))):
            assert rows_of(getattr(got, name), *columns) == rows_of(getattr(want, name), *columns), name
        assert rows_of(have.aliases(), "kind", "name", "alias") == rows_of(all_aliases(table), "kind", "name", "alias")
        assert rows_of(have.vocabulary(), "word") == rows_of(keyword_vocab(table), "word")
    return want


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    rng, path, live = random.Random(7), str(tmp_path / "index"), {}
    index = SegmentedIndex(spark, path, rows_per_shard=2)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)

    def replace(levels):
        new = [chunk(rng, v, i) for v in levels for i in rng.choices(range(9), k=6)]  # ids repeat
        index.replace(frame(new))
        for v in levels:
            live[v] = [r for r in new if r[0] == v]

    def upsert(levels):
        new = [chunk(rng, v, i) for v in levels for i in rng.sample(range(12), 5)]
        index.upsert(frame(new + [chunk(rng, None, 1), ("ug", None) + chunk(rng, "ug", 1)[2:]]))
        for v in {*levels}:
            mine = [r for r in new if r[0] == v]
            live[v] = [r for r in live.get(v, []) if r[1] not in {m[1] for m in mine}] + mine

    def delete(levels):
        gone = [(v, f"{i}") for v in levels for i in rng.sample(range(15), 6)]
        index.delete(spark.createDataFrame(gone + gone[:1] + [("nowhere", "1")], "academic_level string, chunk_id string"))
        for v in levels:
            live[v] = [r for r in live.get(v, []) if (v, r[1]) not in gone]

    replace(["ug", "pg", "a b/=é", ""])
    steps = [upsert, delete, lambda _: index.compact(1), replace, upsert, delete]
    for step in steps:
        step(rng.sample(["ug", "pg", "a b/=é", "", "new"], 2))
    want = same_as_rebuild(spark, index, live, path)
    asked = spark.createDataFrame([(q, v, " ".join(rng.choices(WORDS, k=3))) for q in range(4) for v in ("ug", "pg")],
                                  "query_id long, academic_level string, text string")
    columns = ("query_id", "academic_level", "chunk_id", "rank", "score")
    assert rows_of(bm25_search(asked, index.index(), 5), *columns) == rows_of(bm25_search(asked, want, 5), *columns)


def test_unchanged_levels_are_not_read_and_old_readers_stay(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "index")
    index = SegmentedIndex(spark, path)
    text = lambda v, i, words: (v, f"{i}", words) + chunk(rng, v, i)[3:]
    index.replace(spark.createDataFrame([text(v, i, "fee course") for v in ("ug", "pg") for i in range(3)], SCHEMA))
    reader = SegmentedIndex(spark, path)
    before = rows_of(reader.index().postings, "academic_level", "chunk_id", "token")
    read = []
    plain = SegmentedIndex._read
    index._read = lambda table, segments: (read.extend(s.academic_level for s in segments), plain(index, table, segments))[1]
    index.replace(spark.createDataFrame([text("ug", 1, "exam")], SCHEMA))
    assert read == []  # a replaced level reads no segment, not even its own
    index.upsert(spark.createDataFrame([text("ug", 2, "grade")], SCHEMA))
    index.compact(1)
    assert set(read) == {"ug"}
    assert rows_of(reader.index().postings, "academic_level", "chunk_id", "token") == before
    assert not any("slot=1" in f and "commit=1" in f for f in index.index().postings.inputFiles())  # the dropped segment of ug
    assert {r.token for r in index.index().postings.filter("academic_level = 'ug'").collect()} == {"exam", "grade"}


def test_empty_tables_and_emptied_levels(spark, tmp_path):
    path = str(tmp_path / "index")
    index = SegmentedIndex(spark, path)
    none = spark.createDataFrame([], SCHEMA)
    for change in (index.replace, index.upsert, index.delete):
        change(none)
    assert index.version == 0 and index.index().postings.isEmpty() and index.aliases().isEmpty()
    rng = random.Random(1)
    index.replace(spark.createDataFrame([chunk(rng, "ug", i) for i in range(4)], SCHEMA))
    index.replace(none, emptied=("ug",))
    again = SegmentedIndex(spark, path)
    assert again.version == 2 and again.index().terms.isEmpty() and again.index().corpus.isEmpty() and again.vocabulary().isEmpty()


def test_a_commit_without_a_manifest_is_written_over(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "index")
    first = [chunk(rng, "ug", i) for i in range(4)]
    SegmentedIndex(spark, path, 2).replace(spark.createDataFrame(first, SCHEMA))
    broken = SegmentedIndex(spark, path, 2)
    broken._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(RuntimeError):
        broken.replace(spark.createDataFrame([chunk(rng, "pg", i) for i in range(4)], SCHEMA))
    index = SegmentedIndex(spark, path, 2)
    same_as_rebuild(spark, index, {"ug": first}, path)
    second = [chunk(rng, "ug", i) for i in range(2, 7)]
    index.upsert(spark.createDataFrame(second, SCHEMA))
    same_as_rebuild(spark, index, {"ug": first[:2] + second}, path)


def test_an_upload_is_searchable_and_its_old_names_go(spark, tmp_path):
    source, chunks, status, checkpoint, path = (str(tmp_path / n) for n in ("in", "chunks", "status", "ck", "index"))

    def send(rows):
        spark.createDataFrame(rows, SS.UPLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        SS.stream_ingest(SS.read_uploads(spark, source, files_per_batch=1), chunks, status, checkpoint, available_now=True,
                         index_path=path).awaitTermination()
        return SegmentedIndex(spark, path)

    def found(index, text):
        asked = spark.createDataFrame([(1, "undergraduate", text)], "query_id long, academic_level string, text string")
        return bm25_search(asked, index.index(), 3).count()

    first = send([(1, "undergraduate", 2026, 1, "# Department of Physics\n\noptics laboratory", 1, 1),
                  (2, "postgraduate", 2026, 1, "thesis", 1, 1)])
    assert found(first, "optics") == 1 and found(first, "botany") == 0
    second = send([(3, "undergraduate", 2026, 1, "# Department of Biology\n\nbotany garden", 2, 1)])
    assert found(second, "optics") == 0 and found(second, "botany") == 1
    table = spark.read.schema(SS.CHUNK_SCHEMA).parquet(chunks)
    assert rows_of(second.aliases(), "kind", "name", "alias") == rows_of(all_aliases(table), "kind", "name", "alias")
    assert {r.academic_level for r in second.index().corpus.collect()} == {"undergraduate", "postgraduate"}
