"""Vector arithmetic on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NORM_FLOOR = 1e-9


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: Column, floor: float = NORM_FLOOR) -> Column:
    n = F.greatest(norm(vec), F.lit(floor))
    return F.transform(as_doubles(vec), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine where a zero vector stays zero instead of dividing by zero."""
    d, n = dot(a, b), norm(a) * norm(b)
    return F.when(n > 0, d / n).otherwise(F.lit(0.0))


def mean_pool(tokens: DataFrame, id_col: str = "id", mask_col: str = "mask", vec_col: str = "vec",
              floor: float = NORM_FLOOR) -> DataFrame:
    """Masked mean of token vectors per id: (id, vec). Partial sums combine map-side."""
    cells = tokens.select(id_col, F.col(mask_col).cast("double").alias("_m"),
                          F.posexplode(as_doubles(F.col(vec_col))).alias("_d", "_v"))
    dims = cells.groupBy(id_col, "_d").agg(
        (F.sum(F.col("_v") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(floor))).alias("_v"))
    # one entry per dimension, so the collected list is as long as one vector
    return dims.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda s: s["_v"]).alias(vec_col))


def cls_pool(tokens: DataFrame, id_col: str = "id", pos_col: str = "pos", vec_col: str = "vec") -> DataFrame:
    """Vector of the first token per id."""
    return tokens.groupBy(id_col).agg(F.min_by(as_doubles(F.col(vec_col)), pos_col).alias(vec_col))
