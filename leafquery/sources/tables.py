"""Table maintenance: level replacement, keyed upserts, status rows, sessions, snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fv
from ..functions.staging import small_side

_STRING_LIST = T.ArrayType(T.StringType())
_FACULTY = T.StructType([T.StructField(n, T.StringType()) for n in ("designation", "person_name")])
_COURSE = T.StructType([T.StructField(n, T.StringType()) for n in ("course_code", "course_title", "credit_hours")])
_FEE = T.StructType([T.StructField(n, T.StringType()) for n in ("fee_type", "amount")])

CHUNK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("academic_level", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("page", T.IntegerType()),
    T.StructField("faculty", T.StringType()), T.StructField("department", T.StringType()),
    T.StructField("program", T.StringType()), T.StructField("heading", T.StringType()),
    T.StructField("heading_path", T.StringType()), T.StructField("heading_leaf", T.StringType()),
    T.StructField("heading_depth", T.IntegerType()), T.StructField("section", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("semester", T.IntegerType()),
    T.StructField("course_code", T.StringType()), T.StructField("person_name", T.StringType()),
    T.StructField("designation", T.StringType()), T.StructField("course_codes", _STRING_LIST),
    T.StructField("programs", _STRING_LIST), T.StructField("faculty_entities", T.ArrayType(_FACULTY)),
    T.StructField("curriculum_entities", T.ArrayType(_COURSE)), T.StructField("fee_entities", T.ArrayType(_FEE)),
    T.StructField("h1", T.StringType()), T.StructField("h2", T.StringType()),
    T.StructField("h3", T.StringType()), T.StructField("h4", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_size", T.IntegerType()),
    T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()),
])


# --- chunk tables -----------------------------------------------------------
def replace_level(chunks: DataFrame, path: str, level_col: str = "academic_level") -> None:
    """Swap in the new rows of every level present in ``chunks``; other levels stay.

    Dynamic partition overwrite commits once, so an interrupted write leaves the old set.
    """
    (chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(level_col).parquet(path))


def replaced(existing: DataFrame, new: DataFrame, level_col: str = "academic_level") -> DataFrame:
    """The table after ``replace_level``, as a plan."""
    levels = small_side(new.select(level_col).distinct())
    return existing.join(levels, level_col, "left_anti").unionByName(new)


def upsert_by_id(existing: DataFrame, new: DataFrame, id_col: str = "chunk_id", seq_col: str = "seq") -> DataFrame:
    """Same id -> the new row wins; inside the new rows the highest sequence wins."""
    cols = [c for c in new.columns if c != id_col]
    latest = (new.groupBy(id_col)
              .agg(F.max_by(F.struct(*cols), seq_col).alias("_row"))
              .select(id_col, *[F.col(f"_row.{c}").alias(c) for c in cols]))
    return existing.join(latest.select(id_col), id_col, "left_anti").unionByName(latest.select(*existing.columns))


def flatten_metadata(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Nested values as JSON text (an empty list stays a list of strings) plus one JSON without null keys."""
    out = chunks
    for field in chunks.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StringType):
            out = out.withColumn(field.name, F.when(F.size(field.name) > 0, F.to_json(field.name)))
        elif isinstance(kind, (T.StructType, T.MapType)):
            out = out.withColumn(field.name, F.to_json(field.name))
    return out.withColumn("metadata", F.to_json(F.struct(*out.columns)))


def export_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", level_col: str = "academic_level") -> None:
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported chunk format: {fmt}")
    writer = chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(level_col)
    if fmt == "json":
        # nulls stay visible as nulls, as in the exported files
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)


def read_chunks(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType = CHUNK_SCHEMA) -> DataFrame:
    """Exported chunks; a path that does not exist gives an empty table."""
    return read_or_empty(spark, path, fmt, schema)


def read_or_empty(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- status -----------------------------------------------------------------
STATUS_COLUMNS = ("excluded_pages", "ingestion_status", "ingestion_error")


def upsert_status(table: DataFrame, rows: DataFrame, key: str = "academic_level") -> DataFrame:
    """Keyed upsert that touches only the columns present in ``rows`` (NULL included)."""
    given = [c for c in rows.columns if c != key]
    new = rows.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in given])
    defaults = {"excluded_pages": F.array().cast("array<int>"), "ingestion_status": F.lit(fv.IDLE_STATUS)}
    old = table.withColumn("_old", F.lit(True))
    joined = old.join(new, key, "full_outer")
    cols = []
    for c in table.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in given:
            cols.append(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            kept = F.when(F.col("_old"), F.col(c)).otherwise(defaults.get(c, F.lit(None)))
            cols.append(kept.alias(c))
    return joined.select(*cols)


def read_status(table: DataFrame, levels: DataFrame, key: str = "academic_level") -> DataFrame:
    """One row per asked level; absent or null status reads as idle."""
    return (levels.select(key).distinct().join(table, key, "left")
            .select(key, F.coalesce("excluded_pages", F.array().cast("array<int>")).alias("excluded_pages"),
                    F.coalesce(F.nullif("ingestion_status", F.lit("")), F.lit(fv.IDLE_STATUS)).alias("ingestion_status"),
                    "ingestion_error"))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str, seq_col: str | None = None) -> DataFrame:
    """The rows that were really inserted: key not in the table, one row per key (lowest sequence first)."""
    fresh = rows.join(table.select(key), key, "left_anti")
    if seq_col is None:
        return fresh.dropDuplicates([key])
    cols = [c for c in rows.columns if c != key]
    return (fresh.groupBy(key).agg(F.min_by(F.struct(*cols), seq_col).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in cols]))


# --- sessions ---------------------------------------------------------------
def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions of known users that have not expired at ``now`` (equal counts as active)."""
    live = sessions.filter(F.col("expires_at") >= now)
    return live.join(users, live["user_id"] == users["id"]).select("token", "id", "username", "role", "expires_at")


def role_counts(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("n_users"))


# --- caches as tables -------------------------------------------------------
def save_snapshot(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_or_empty(spark, path, "json", schema)
