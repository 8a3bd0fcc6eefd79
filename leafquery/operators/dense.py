"""Exact nearest neighbours by cosine, with per-question levels and filters."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed_values as fv
from .ranking import RANK_DIGITS, by_score, top_k

FACETS = ("department", "section", "faculty")
#: questions that may be broadcast together, by rows and by bytes of their vectors
BROADCAST_ROWS = 8192
BROADCAST_BYTES = 64 << 20
#: corpus rows and question rows that meet in one task of the grid
CELL_ROWS = 16384
CELL_QUERIES = 4096
#: cells grow up to the sizes above where smaller ones would copy each row of a group more often than this
COPIES = 16
#: cells for each pair of full blocks, so that few pairs fall into one cell by chance
CELLS_PER_PAIR = 4
#: groups whose block counts may be broadcast
BROADCAST_GROUPS = 100_000
#: products that are held at once, as numbers
_MATMUL_CELLS = 1 << 20
#: questions of the same filter values that are compared with the rows of these values alone
_LEAST_ASKED = 16
#: maxima of columns that are made for each row of a result
_MAXIMA = 16
#: stands for a missing filter or field value
NO_VALUE = 0


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _row_slices(n: int, width: int) -> Iterator[slice]:
    """``n`` rows in slices of which a product with ``width`` columns stays small."""
    step = max(1, _MATMUL_CELLS // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def ids_at(ids: pd.Series, at: np.ndarray) -> pd.Series:
    """Ids of some rows: integers as they are, anything else as plain objects, since string arrays of several chunks cannot be sent back.

    Integers of which some are missing arrive as floats and are made integers again.
    """
    numeric = len(ids) and isinstance(ids.iloc[0], (int, np.integer))
    values = ids.to_numpy(np.int64 if numeric else object)
    if ids.dtype.kind == "f":
        values = np.array([None if x != x else int(x) if x == x // 1 else x for x in values.tolist()] or [None], object)
    return pd.Series(values[at])


_NO_ROWS = np.zeros(0, np.int64)


def rows_of_code(codes: pd.Series) -> dict[int, np.ndarray]:
    """Rows that have a course code, for each code; made once for a block."""
    count = np.array([len(x) for x in codes], np.int64)
    if not count.sum():
        return {}
    flat = np.concatenate([np.asarray(x, np.int64) for x in codes])
    pairs = np.unique(np.stack([flat, np.repeat(np.arange(len(count)), count)]), axis=1)
    cuts = np.flatnonzero(np.diff(pairs[0])) + 1
    return {int(pairs[0, a]): pairs[1, a:b] for a, b in zip([0, *cuts], [*cuts, pairs.shape[1]])}


class Filters:
    """Which columns (corpus rows) each question may find: every filter that is set agrees, a code is one of the row's."""

    def __init__(self, wanted: list[np.ndarray], have: list[np.ndarray], code: np.ndarray, of_code: dict[int, np.ndarray], width: int):
        self.wanted = np.stack([*wanted, code], axis=1)
        self.have, self.of_code, self.width = have, of_code, width

    def _columns(self, wanted: np.ndarray) -> np.ndarray:
        ok = np.ones(self.width, bool)
        for w, have in zip(wanted[:-1], self.have):
            if w != NO_VALUE:
                ok &= have == w
        if wanted[-1] != NO_VALUE:
            with_code = np.zeros(self.width, bool)
            with_code[self.of_code.get(int(wanted[-1]), _NO_ROWS)] = True
            ok &= with_code
        return np.flatnonzero(ok)

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Questions that ask for the same values, and the columns that these may find. Questions of values that fewer than
        ``_LEAST_ASKED`` ask for come together, with None: ``allowed`` has the columns of each."""
        kinds, kind, asked = np.unique(self.wanted, axis=0, return_inverse=True, return_counts=True)
        kind = kind.ravel()
        often = (asked >= _LEAST_ASKED) | (kinds == NO_VALUE).all(axis=1)
        by_kind = np.split(np.argsort(kind, kind="stable"), np.cumsum(asked)[:-1]) if len(kinds) else []
        for n in np.flatnonzero(often):
            yield by_kind[n], self._columns(kinds[n])
        seldom = np.flatnonzero(~often[kind])
        if len(seldom):
            yield seldom, None

    def allowed(self, questions: np.ndarray) -> np.ndarray:
        """(questions, columns)"""
        kinds, kind = np.unique(self.wanted[questions], axis=0, return_inverse=True)
        ok = np.zeros((len(kinds), self.width), bool)
        for n, wanted in enumerate(kinds):
            ok[n, self._columns(wanted)] = True
        return ok[kind.ravel()]


def best_pairs(score: np.ndarray, ok: np.ndarray | None, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest allowed scores of every row, by row and rank; scores go by ``RANK_DIGITS`` digits, ties by column.
    Scores below ``least`` are none.

    The k-th largest of the maxima of some columns each is a floor of the k-th score, so only what reaches it is rounded and sorted.
    """
    n, width = score.shape
    if not n or not width:
        return _NO_ROWS, _NO_ROWS
    held = score if ok is None else np.where(ok, score, -np.inf)
    together = max(1, width // (_MAXIMA * k))
    if width // together > k:
        m = width // together
        most = held[:, :m * together].reshape(n, together, m).max(axis=1)
        floor = np.partition(most, m - k, axis=1)[:, m - k] - 2 * 10.0 ** -RANK_DIGITS
        found = held >= np.maximum(floor, least)[:, None]
    else:
        found = held >= least
    if ok is not None:
        found &= ok
    row, column = np.divmod(np.flatnonzero(found), width)
    order = np.lexsort((column, -np.round(score[row, column], RANK_DIGITS), row))
    row, column = row[order], column[order]
    counts = np.bincount(row, minlength=n)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row[rank < k], column[rank < k]


def _best_of_block(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k corpus rows of the block for every question with the same group and matching filters."""
    out_q, out_c, out_raw = [], [], []
    if len(q) and len(c):
        c = c.sort_values("cid", kind="stable").reset_index(drop=True)
        q_rows = {g: np.asarray(i) for g, i in q.reset_index(drop=True).groupby("grp").indices.items()}
        c_rows = c.groupby("grp").indices
        q_facets = [q[f"f_{f}"].to_numpy(np.int64) for f in FACETS]
        c_facets = [c[f].to_numpy(np.int64) for f in FACETS]
        q_code = q["f_code"].to_numpy(np.int64)
        for g, ci in c_rows.items():
            rows = q_rows.get(g)
            if rows is None:
                continue
            ci = np.sort(np.asarray(ci))
            qv, cv = _unit(q["vec"].iloc[rows]), _unit(c["vec"].iloc[ci])
            filters = Filters([x[rows] for x in q_facets], [x[ci] for x in c_facets], q_code[rows],
                              rows_of_code(c["codes"].iloc[ci]) if q_code[rows].any() else {}, len(ci))
            for asked, columns in filters.groups():
                some_c = slice(None) if columns is None or len(columns) == len(ci) else columns
                of_group, where = cv[some_c], ci[some_c]
                for some in _row_slices(len(asked), len(where)):
                    raw = qv[asked[some]] @ of_group.T
                    row, column = best_pairs(raw, None if columns is not None else filters.allowed(asked[some]), k)
                    out_q.append(rows[asked[some][row]])
                    out_c.append(where[column])
                    out_raw.append(raw[row, column])
    at_q, at_c, raw = [np.concatenate(x) if x else _NO_ROWS for x in (out_q, out_c, out_raw)]
    return pd.DataFrame({"qid": ids_at(q["qid"], at_q), "cid": ids_at(c["cid"], at_c),
                         "score": np.round(raw.astype(np.float64), RANK_DIGITS), "raw": raw.astype(np.float64)})


def _reduce(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(parts, ignore_index=True).sort_values(["qid", "score", "cid"], ascending=[True, False, True])
    return rows.groupby("qid", sort=False).head(k)


def _hash(df: DataFrame, name: str) -> Column:
    """64-bit stand-in for a value to compare; a missing one is NO_VALUE, so the column has no NULL."""
    if name not in df.columns:
        return F.lit(NO_VALUE).cast("long")
    return F.when(F.col(name).isNull(), F.lit(NO_VALUE).cast("long")).otherwise(F.xxhash64(name))


def _question_side(queries: DataFrame, query_id: str, vec: str, level: str | None) -> DataFrame:
    group = F.xxhash64(level) if level else F.lit(0).cast("long")
    return queries.filter(F.col(vec).isNotNull()).select(
        F.col(query_id).alias("qid"), F.col(vec).alias("vec"), group.alias("grp"),
        *[_hash(queries, f"f_{f}").alias(f"f_{f}") for f in FACETS], _hash(queries, "f_course_code").alias("f_code"))


def _corpus_side(corpus: DataFrame, chunk_id: str, vec: str, level: str | None) -> DataFrame:
    group = F.xxhash64(level) if level else F.lit(0).cast("long")
    codes = F.array().cast("array<long>")
    if "course_codes" in corpus.columns:
        codes = F.coalesce(F.transform("course_codes", lambda x: F.xxhash64(F.upper(x))), codes)
    return corpus.filter(F.col(vec).isNotNull()).select(
        F.col(chunk_id).alias("cid"), F.col(vec).alias("vec"), group.alias("grp"),
        *[_hash(corpus, f).alias(f) for f in FACETS], codes.alias("codes"))


def _hit_schema(q: DataFrame, c: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("cid", c.schema["cid"].dataType),
                         T.StructField("score", T.DoubleType()), T.StructField("raw", T.DoubleType())])


def _scan_with_block(q_block: pd.DataFrame, c: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """The corpus is scanned once where it lies; each task keeps only k rows per question."""
    shared = c.sparkSession.sparkContext.broadcast(q_block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, parts, held = shared.value, [], 0
        for batch in batches:
            best = _best_of_block(q, batch, k)
            parts.append(best)
            held += len(best)
            if held > 4 * k * max(len(q), 1):
                parts = [_reduce(parts, k)]
                held = len(parts[0])
        if parts:
            yield _reduce(parts, k)

    return c.mapInPandas(scan, schema)


def _grid(q: DataFrame, c: DataFrame, k: int, schema: T.StructType, cell_rows: int, cell_queries: int) -> DataFrame:
    """Both sides too large to broadcast: cut each group into blocks and let block pairs meet.

    A block holds about ``cell_rows`` corpus rows and ``cell_queries`` questions whatever
    the size of its group, so one hot group is many cells. Small groups share cells. Blocks below ``CELL_ROWS`` and
    ``CELL_QUERIES`` grow towards these where a large group would else be copied more than ``COPIES`` times.
    """
    n_q = q.groupBy("grp").agg(F.count(F.lit(1)).alias("_nq"))
    n_c = c.groupBy("grp").agg(F.count(F.lit(1)).alias("_nc"))

    def blocks(n: str, asked: int, most: int) -> Column:
        size = F.greatest(F.lit(asked), F.least(F.lit(most), F.ceil(F.col(n) / COPIES)))
        return F.ceil(F.col(n) / size).cast("int")

    dims = n_q.join(n_c, "grp").select("grp", "_nc", blocks("_nc", cell_rows, CELL_ROWS).alias("_ci"),
                                       blocks("_nq", cell_queries, CELL_QUERIES).alias("_qj"))
    groups, work, pairs = dims.agg(F.count(F.lit(1)), F.sum(F.col("_nc") * F.col("_qj")),
                                   F.sum(F.col("_ci").cast("long") * F.col("_qj"))).first()
    n_cells = max(1, min(CELLS_PER_PAIR * (pairs or 0), math.ceil(CELLS_PER_PAIR * (work or 0) / cell_rows)))
    dims = dims.drop("_nc")
    if groups <= BROADCAST_GROUPS:
        dims = F.broadcast(dims)

    def placed(df: DataFrame, own: str, other: str, id_col: str, own_n: str, other_n: str) -> DataFrame:
        cols = df.columns
        out = df.join(dims, "grp").select(
            *cols, F.pmod(F.xxhash64(id_col), F.col(own_n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))
        pair = F.xxhash64("grp", "_i", "_j")
        return out.select(*[c_ for c_ in cols if c_ != "grp"], pair.alias("grp"),
                          F.pmod(pair, F.lit(n_cells)).alias("_cell"))

    q_cells = placed(q, "_j", "_i", "qid", "_qj", "_ci")
    c_cells = placed(c, "_i", "_j", "cid", "_ci", "_qj")
    return (q_cells.groupBy("_cell").cogroup(c_cells.groupBy("_cell"))
            .applyInPandas(lambda a, b: _best_of_block(a, b, k), schema))


def knn_search(queries: DataFrame, corpus: DataFrame, k: int | str, k_max: int | None = None,
               query_id: str = "query_id", chunk_id: str = "chunk_id", query_vec: str = "vec",
               corpus_vec: str = "vec", level: str | None = None, broadcast_rows: int = BROADCAST_ROWS,
               broadcast_bytes: int = BROADCAST_BYTES, cell_rows: int = CELL_ROWS,
               cell_queries: int = CELL_QUERIES, with_raw: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank[, raw]): cosine top ``k`` of each question, exact.

    Scores are rounded so that ranks don't depend on partitions; ``raw`` is the cosine before that.

    ``k`` is a number or the name of a per-question column (then ``k_max`` bounds it). A
    question may come once per level it searches. Filter columns f_department, f_section,
    f_faculty and f_course_code apply where they are not NULL. A question block of checked
    size is broadcast to a single scan of the corpus; a larger one goes through the grid.
    """
    limit = k if isinstance(k, int) else k_max
    if limit is None:
        raise ValueError("a per-question k needs k_max")
    q, c = (_question_side(queries, query_id, query_vec, level), _corpus_side(corpus, chunk_id, corpus_vec, level))
    schema = _hit_schema(q, c)
    block = q.limit(broadcast_rows + 1).toPandas()  # bounded by the limit
    width = max((len(v) for v in block["vec"]), default=0)
    if len(block) <= broadcast_rows and len(block) * width * 8 <= broadcast_bytes:
        hits = _scan_with_block(block, c, limit, schema)
    else:
        hits = _grid(q, c, limit, schema, cell_rows, cell_queries)
    hits = hits.select(F.col("qid").alias(query_id), F.col("cid").alias(chunk_id), "score", *["raw"] * with_raw)
    ranked = top_k(hits, [query_id], by_score("score", chunk_id), limit)
    if isinstance(k, str):
        ranked = (ranked.join(queries.select(query_id, k).distinct(), query_id)
                  .filter(F.col("rank") < F.col(k)).drop(k))
    return ranked


def max_similarity(queries: DataFrame, prototypes: DataFrame, classes: tuple[str, ...],
                   query_id: str = "query_id", query_vec: str = "vec", class_col: str = "class",
                   prototype_vec: str = "vec", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, <class>_sim ...): best cosine per class.

    Prototypes are the side that is small by nature: with a checked size they are
    broadcast and the questions are scanned in place without a shuffle.
    """
    wanted = prototypes.filter(F.col(class_col).isin(*classes)).select(
        F.col(class_col).alias("cls"), F.col(prototype_vec).alias("vec"))
    block = wanted.limit(broadcast_rows + 1).toPandas()  # bounded by the limit
    names = [f"{n}_sim" for n in classes]
    id_type = queries.schema[query_id].dataType
    asked = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("qid"), F.col(query_vec).alias("vec"))
    if len(block) > broadcast_rows:
        best = queries.select(query_id)
        for n, sim in zip(classes, names):
            of_class = wanted.filter(F.col("cls") == n).withColumn("_id", F.xxhash64("vec"))
            hits = knn_search(queries, of_class, 1, query_id=query_id, chunk_id="_id", query_vec=query_vec)
            best = best.join(hits.select(query_id, F.col("score").alias(sim)), query_id, "left")
        return best
    units = {n: _unit(block.loc[block["cls"] == n, "vec"]) if (block["cls"] == n).any() else None for n in classes}
    shared = queries.sparkSession.sparkContext.broadcast(units)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            unit, out = _unit(batch["vec"]), {"qid": ids_at(batch["qid"], slice(None))}
            for n in classes:
                proto = shared.value[n]
                out[f"{n}_sim"] = None if proto is None else np.concatenate(
                    [(unit[some] @ proto.T).max(axis=1) for some in _row_slices(len(unit), len(proto))])
            yield pd.DataFrame(out)

    schema = T.StructType([T.StructField("qid", id_type), *[T.StructField(n, T.DoubleType()) for n in names]])
    return asked.mapInPandas(score, schema).withColumnRenamed("qid", query_id)


def retrieval_confidence(queries: DataFrame, hits: DataFrame, query_id: str = "query_id",
                         threshold: float = fv.CONFIDENCE_THRESHOLD) -> DataFrame:
    """(query_id, confidence, is_low): mean of the top five scores, 0 without any."""
    mean = (hits.filter(F.col("rank") < fv.CONFIDENCE_TOP).groupBy(query_id).agg(F.avg("score").alias("_c")))
    score = F.coalesce("_c", F.lit(0.0))
    return (queries.select(query_id).join(mean, query_id, "left")
            .select(query_id, score.alias("confidence"), (score < threshold).alias("is_low")))
