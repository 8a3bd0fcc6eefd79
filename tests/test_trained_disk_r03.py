"""Training keeps one block of the iteration on disk, and never shuffles the cells of the matrix."""

import os

import numpy as np
from pyspark.sql import functions as F

from leafquery.functions.staging import shared_folder
from leafquery.operators import trained as TR


def test_blocks_are_removed_and_parts_change_nothing(spark, monkeypatch):
    texts = spark.range(60).select(F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 13).cast("string")) for k in range(1, 12)]).alias("text"))
    folder = shared_folder(spark).removeprefix("file:")

    def trained():
        before = set(os.listdir(folder))
        model = TR.train(texts, dimension=3, least=2, extra=2, steps=5)
        rows = {r.token: np.array(r.vec) for r in model.tokens.collect()}
        return rows, len(set(os.listdir(folder)) - before)

    whole, kept = trained()
    # tokens, sums, cells, the last block and the result
    assert kept <= 5
    monkeypatch.setattr(TR, "BROADCAST_BYTES", 400)
    cut, _ = trained()
    assert TR._parts(13, 5) > 1 and whole.keys() == cut.keys()
    gram = [np.array([[m[a] @ m[b] for a in sorted(m)] for b in sorted(m)]) for m in (whole, cut)]
    assert np.allclose(*gram, atol=1e-6)
    cells = spark.createDataFrame([("a", "b", 1.0)], "i string, j string, v double")
    block = spark.createDataFrame([("b", 2.0)], "token string, c0 double")
    plan = TR._times(cells, block, 1, 3)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
