"""Top-k per key with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: scores are ranked after rounding, so that summation order cannot change a rank
RANK_DIGITS = 6


def by_score(score: str, *ties: str) -> list[Column]:
    return [F.round(F.col(score), RANK_DIGITS).desc(), *[F.col(t).asc() for t in ties]]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, k_max: int | None = None,
          rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key with a 0-based rank.

    ``k`` may differ per row; ``k_max`` then is its largest value. The literal limit lets
    Spark cut every group inside each partition before the shuffle (WindowGroupLimit).
    """
    limit = k if isinstance(k, int) else k_max
    if limit is None:
        raise ValueError("a per-row k needs k_max")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    if not isinstance(k, int):
        out = out.filter(F.col("_rn") <= k)
    return out.withColumn(rank_col, F.col("_rn") - 1).drop("_rn")
