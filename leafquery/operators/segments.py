"""A BM25 index and its vocabularies kept up to date by segments, without counting unchanged levels again.

Each change is one commit. It writes the postings, counts and names that it brings as folders of its own, one partition
(slot) for each level, and at the end the manifest: the list of live segments. Counts are signed: a chunk that is replaced
or deleted gets a tombstone, and the commit that writes it subtracts what the chunk had added. So the statistics of a level are
sums over its segments, a name leaves the vocabulary when its count is zero, and only postings are filtered by
tombstones. A level that is replaced whole drops its segments from the manifest and reads nothing of them.

A commit is visible once its manifest is, and a manifest is one file; what an interrupted commit left is overwritten
by the next one. One writer at a time; readers keep the version they opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.staging import small_side, stage
from ..sources.tables import read_or_empty
from .bm25 import FACETS, MAX_LEVELS, ROWS_PER_SHARD, Bm25Index, bm25_index
from .vocab import all_aliases, keyword_vocab

NAMES = ("department", "designation", "faculty", "program")
#: live segments of a level before ``compact`` unites them
MOST_SEGMENTS = 8

#: columns of each table; ``{id}`` is the type of the ids
COLUMNS = {
    "postings": "academic_level string, token string, chunk_id {id}, doc_len int, department string, section string, "
                "faculty string, course_codes array<string>, tf int",
    "chunks": "academic_level string, chunk_id {id}, department string, designation string, faculty string, program string",
    "terms": "academic_level string, token string, df long, cf long",
    "names": "academic_level string, kind string, name string, n long",
    "tombstones": "academic_level string, chunk_id {id}"}
#: the last five count the rows that a segment has in each table
MANIFEST = "academic_level string, commit long, slot int, id_type string, n long, len long, " + ", ".join(f"{t} long" for t in COLUMNS)


class SegmentedIndex:
    """Index tables under ``path``, opened at their newest version.

    Rows without a level or an id are left out. Several rows of one id are all indexed, as ``bm25_index`` does, and
    replaced together. An empty table changes nothing; columns of the chunk table that the index does not know are
    ignored. The type of the ids is that of the first write.
    """

    def __init__(self, spark: SparkSession, path: str, rows_per_shard: int = ROWS_PER_SHARD):
        self.spark, self.path, self.rows_per_shard = spark, path, rows_per_shard
        log = read_or_empty(spark, f"{path}/manifest", "parquet", T.StructType.fromDDL(MANIFEST + ", version long"))
        self.version = log.agg(F.max("version")).first()[0] or 0
        # a row for each live segment of each level: both numbers are bounded (MAX_LEVELS, compact)
        newest = log.filter(F.col("version") == self.version)
        self.segments: list[Row] = [r for r in newest.drop("version").collect() if r.commit is not None]
        self.id_type = self.segments[0].id_type if self.segments else None
        self._new: dict[str, dict[int, int]] = {}

    # --- changes --------------------------------------------------------------
    def replace(self, chunks: DataFrame, text: Column | None = None, level: str = "academic_level",
                chunk_id: str = "chunk_id", emptied: tuple[str, ...] = ()) -> None:
        """Every level of ``chunks`` gets these chunks and no others; levels in ``emptied`` lose all of theirs."""
        rows = self._rows(chunks, text, level, chunk_id)
        levels = self._levels(rows)
        kept = [s for s in self.segments if s.academic_level not in {*levels, *emptied}]
        if not levels and len(kept) == len(self.segments):
            return
        self._commit(rows, None, levels, kept, [])

    def upsert(self, chunks: DataFrame, text: Column | None = None, level: str = "academic_level",
               chunk_id: str = "chunk_id") -> None:
        """Chunks whose (level, id) is known are replaced, the others are added."""
        rows = self._rows(chunks, text, level, chunk_id)
        levels = self._levels(rows)
        if levels:
            self._commit(rows, rows.select("academic_level", "chunk_id"), levels, self.segments, self._of(levels))

    def delete(self, ids: DataFrame) -> None:
        """Remove the chunks named by (academic_level, chunk_id); unknown ones are passed over."""
        if not self.segments:
            return
        rows = stage(ids.select("academic_level", F.col("chunk_id").cast(self.id_type).alias("chunk_id")).dropna())
        known = {s.academic_level for s in self.segments}
        levels = [v for v in self._levels(rows) if v in known]
        if levels:
            self._commit(None, rows, levels, self.segments, self._of(levels))

    def compact(self, most: int = MOST_SEGMENTS) -> None:
        """Unite the segments of every level that has more than ``most``; other levels are not read."""
        count: dict[str, int] = {}
        for s in self.segments:
            count[s.academic_level] = count.get(s.academic_level, 0) + 1
        levels = sorted(v for v, c in count.items() if c > most)
        if not levels:
            return
        old, slots = self._of(levels), self._slots(levels)
        self._write("postings", self._live("postings", old), slots, "token")
        self._write("chunks", self._live("chunks", old), slots, "chunk_id")
        self._write("terms", self._summed("terms", old, "token", "df", "cf"), slots, "token")
        self._write("names", self._summed("names", old, "kind", "name", "n"), slots, "name")
        total = {v: (sum(s.n for s in old if s.academic_level == v), sum(s.len for s in old if s.academic_level == v))
                 for v in levels}
        self._publish(levels, total, [s for s in self.segments if s.academic_level not in levels])

    # --- reading --------------------------------------------------------------
    def index(self) -> Bm25Index:
        """The tables that ``bm25_index`` would make of all live chunks."""
        total: dict[str, list[int]] = {}
        for s in self.segments:
            sums = total.setdefault(s.academic_level, [0, 0])
            sums[0] += s.n
            sums[1] += s.len
        corpus = self.spark.createDataFrame([(v, n, size / n) for v, (n, size) in total.items() if n],
                                            "academic_level string, n long, avgdl double")
        n, d = F.col("n"), F.col("df")
        terms = (self._summed("terms", self.segments, "token", "df", "cf").join(F.broadcast(corpus), "academic_level")
                 .select("academic_level", "token", "df", F.log((n - d + 0.5) / (d + 0.5) + 1.0).alias("idf"),
                         F.ceil(d / F.lit(self.rows_per_shard)).cast("int").alias("shards")))
        return Bm25Index(self._live("postings", self.segments), terms, corpus)

    def names(self) -> DataFrame:
        """(academic_level, kind, name, n): in how many live chunks a name stands."""
        return self._summed("names", self.segments, "kind", "name", "n")

    def aliases(self) -> DataFrame:
        """``all_aliases`` of all live chunks."""
        return all_aliases(self._named())

    def vocabulary(self, existing: DataFrame | None = None) -> DataFrame:
        """``keyword_vocab`` of all live chunks."""
        return keyword_vocab(self._named(), existing)

    def _named(self) -> DataFrame:
        names = self.names().select("kind", "name").distinct()
        return names.select(*[F.when(F.col("kind") == k, F.col("name")).alias(k) for k in NAMES])

    # --- segments -------------------------------------------------------------
    def _of(self, levels: list[str]) -> list[Row]:
        return [s for s in self.segments if s.academic_level in set(levels)]

    def _schema(self, table: str) -> str:
        return COLUMNS[table].format(id=self.id_type or "string")

    def _read(self, table: str, segments: list[Row]) -> DataFrame:
        root, schema = f"{self.path}/{table}", f"{self._schema(table)}, commit long, slot int"
        paths = [f"{root}/commit={s.commit}/slot={s.slot}" for s in segments if s[table]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def _live(self, table: str, segments: list[Row]) -> DataFrame:
        """Rows of chunks that no later commit has replaced or deleted."""
        rows = self._read(table, segments)
        if not any(s.tombstones for s in segments):
            return rows.drop("commit", "slot")
        key = ["academic_level", "chunk_id"]
        last = self._read("tombstones", segments).groupBy(*key).agg(F.max("commit").alias("_until"))
        return (rows.join(small_side(last), key, "left")
                .filter(F.col("_until").isNull() | (F.col("_until") <= F.col("commit"))).drop("commit", "slot", "_until"))

    def _summed(self, table: str, segments: list[Row], *columns: str) -> DataFrame:
        counts = [c for c in columns if c in ("df", "cf", "n")]
        keys = ["academic_level", *[c for c in columns if c not in counts]]
        sums = self._read(table, segments).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
        return sums.filter(F.col(counts[0]) > 0)

    # --- commits --------------------------------------------------------------
    def _rows(self, chunks: DataFrame, text: Column | None, level: str, chunk_id: str) -> DataFrame:
        """The columns that the index knows, written once: several tables are made of them."""
        def known(name: str) -> Column:
            kind = "array<string>" if name == "course_codes" else "string"
            return (F.col(name) if name in chunks.columns else F.lit(None)).cast(kind).alias(name)

        fields = dict.fromkeys([*FACETS, *NAMES])
        if self.id_type is None:
            self.id_type = chunks.schema[chunk_id].dataType.simpleString()
        return stage(chunks.select(F.col(level).cast("string").alias("academic_level"),
                                   F.col(chunk_id).cast(self.id_type).alias("chunk_id"),
                                   *[known(c) for c in fields], (F.col("text") if text is None else text).alias("text"))
                     .dropna(subset=["academic_level", "chunk_id"]))

    @staticmethod
    def _levels(rows: DataFrame) -> list[str]:
        found = rows.select("academic_level").distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels")
        return sorted(r[0] for r in found)

    def _slots(self, levels: list[str]) -> DataFrame:
        """(academic_level, slot): a level may be any string, a folder is a number."""
        return F.broadcast(self.spark.createDataFrame(list(zip(levels, range(len(levels)))), "academic_level string, slot int"))

    def _commit(self, rows: DataFrame | None, gone: DataFrame | None, levels: list[str], kept: list[Row], old: list[Row]) -> None:
        """Write one segment for each level: the chunks in ``rows``, less those named by ``gone`` in the segments ``old``."""
        if not levels:
            return self._publish([], {}, kept)
        slots, key = self._slots(levels), ["academic_level", "chunk_id"]
        parts: dict[str, list[DataFrame]] = {"chunks": [], "postings": []}
        if rows is not None:
            added = bm25_index(rows).postings
            self._write("postings", added, slots, "token")
            self._write("chunks", rows.select(*key, *NAMES), slots, "chunk_id")
            parts = {t: [self._written(t).withColumn("_sign", F.lit(1))] for t in parts}
        if gone is not None and old:
            # only ids that are live: unknown ones need no tombstone
            known = self._live("chunks", old)
            self._write("tombstones", gone.distinct().join(known.select(*key).distinct(), key, "left_semi"), slots, "chunk_id")
            dead = small_side(self._written("tombstones").select(*key))
            for table in parts:
                hidden = self._live(table, old).join(dead, key, "left_semi").withColumn("_sign", F.lit(-1))
                parts[table].append(hidden)
        chunks, postings = (self._united(parts[t]) for t in ("chunks", "postings"))
        sign, tf = F.col("_sign"), F.col("tf")
        if postings is not None:
            terms = postings.groupBy("academic_level", "token").agg(
                F.sum(sign).alias("df"), F.sum(sign * tf).alias("cf")).filter("df != 0 or cf != 0")
            self._write("terms", terms, slots, "token")
        total = {}
        if chunks is not None:
            pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in NAMES]))
            names = (chunks.select("academic_level", "_sign", pairs.alias("_p")).filter("_p.name is not null")
                     .groupBy("academic_level", "_p.kind", "_p.name").agg(F.sum("_sign").alias("n")).filter("n != 0"))
            self._write("names", names, slots, "name")
            size = {r[0]: r[1] for r in self._written("terms").groupBy("academic_level").agg(F.sum("cf")).collect()}
            total = {r[0]: (r[1], size.get(r[0]) or 0)
                     for r in chunks.groupBy("academic_level").agg(F.sum("_sign")).collect()}
        self._publish(levels, total, kept)

    @staticmethod
    def _united(parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for p in parts:
            p = p.drop("commit", "slot")
            out = p if out is None else out.unionByName(p)
        return out

    def _write(self, table: str, rows: DataFrame, slots: DataFrame, order: str) -> None:
        folder = f"{self.path}/{table}/commit={self.version + 1}"
        names = T.StructType.fromDDL(self._schema(table)).fields
        (rows.join(slots, "academic_level").select(*[F.col(f.name).cast(f.dataType) for f in names], "slot")
         .sortWithinPartitions("slot", order).write.mode("overwrite").partitionBy("slot").parquet(folder))
        self._new[table] = {r["slot"]: r["count"] for r in self._written(table).groupBy("slot").count().collect()}

    def _written(self, table: str) -> DataFrame:
        """What the commit in hand has written of a table."""
        folder = f"{self.path}/{table}/commit={self.version + 1}"
        return self.spark.read.schema(f"{self._schema(table)}, slot int").parquet(folder)

    def _publish(self, levels: list[str], total: dict[str, tuple[int, int]], kept: list[Row]) -> None:
        segments = list(kept)
        for i, v in enumerate(levels):
            values = [v, self.version + 1, i, self.id_type, *total.get(v, (0, 0)),
                      *[self._new.get(t, {}).get(i, 0) for t in COLUMNS]]
            segments.append(Row(**dict(zip(T.StructType.fromDDL(MANIFEST).names, values))))
        # a version without live segments is one row of nulls, so that it is found as the newest
        rows = [tuple(s) for s in segments] or [(None,) * len(T.StructType.fromDDL(MANIFEST))]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error")
         .parquet(f"{self.path}/manifest/version={self.version + 1}"))
        self.version, self.segments, self._new = self.version + 1, segments, {}
