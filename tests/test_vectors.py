from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import retrieval as R
from foliospark.plans.search import knn_recall
from foliospark.sources.vectors import VectorIndex


def frame(spark, x, extra=()):
    return spark.createDataFrame([(f"v{i}", [float(v) for v in r], 1) for i, r in enumerate(x)] + list(extra), "id string, embedding array<float>, cell int")


def test_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(60, 16))
    x = heart[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    df = frame(spark, x, [("n", None, 1), ("z", [0.0] * 16, 1), ("s", [1.0], 1), ("q", [float("nan")] * 16, 1)]).cache()
    index = VectorIndex.build(df, str(tmp_path / "ann"), dim=16)
    assert len(index.centres()) == 77 and spark.read.parquet(str(tmp_path / "ann" / "cells")).count() == 6000
    found, truth = [], []
    for i in range(0, 6000, 600):
        query = [float(v) for v in x[i]]
        found.append(index.search(query, 10).withColumn("query", F.lit(i)))
        truth.append(R.knn(df, query, 10).withColumn("query", F.lit(i)))
    both = [reduce(lambda a, b: a.unionByName(b), parts) for parts in (found, truth)]
    assert knn_recall(*both) >= 0.9
    assert knn_recall(index.search(query, 10, probes=77).withColumn("query", F.lit(1)), truth[-1].withColumn("query", F.lit(1))) == 1.0
    plan = index.search(query, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "In(cell" in plan


def test_small_equal_and_empty(spark, tmp_path):
    df = frame(spark, np.ones((50, 4)))
    assert VectorIndex.build(df, str(tmp_path / "a"), dim=4).search([1.0] * 4, 5).count() == 5
    assert VectorIndex.build(df.filter("false"), str(tmp_path / "b"), dim=4).search([1.0] * 4, 5).count() == 0
