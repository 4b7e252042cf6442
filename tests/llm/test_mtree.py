"""Exact top-k against all inner products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from prosemill.llm import mtree


def brute(rows, k):
    fine = [(i, [max(-(2**63), min(2**63 - 1, math.floor(64 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(fine):
        if q % 20 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for j, (i, b) in enumerate(fine) if j != at)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def found(df, **kwargs):
    return sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 20 == 0, **kwargs).select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k_of_odd_vectors(spark):
    rng = random.Random(3)
    near = lambda c: [c[j] + rng.gauss(0, 0.1) for j in range(6)]
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, near(middles[i % 4])) for i in range(700)] + [(700 + i, [0.5] * 6) for i in range(300)] + [(1000 + i, [0.1, -0.2, 0.3, 0.0, 0.0, 0.0]) for i in range(5)]
    rows += [(2000, None), (2020, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    assert found(df) == want
    assert found(df, tree_rows=100, query_rows=7) == want
    assert found(df.limit(0)) == [] and len(found(df.where("vec_id < 3"))) == 2


def test_top_k_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert found(df, tree_rows=150) == brute([(r.vec_id, r.embedding) for r in df.collect()], 20)


def test_bounds_spare_computations():
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 200, (20, 8))
    v = np.rint(np.concatenate([m + rng.normal(0, 3, (300, 8)) for m in middles])).astype(np.int32)
    t = mtree.build(np.arange(len(v)), np.arange(len(v)), v, page=128)
    scores, _, _, computed = mtree.search(t, v[5:6], np.array([5]), 20)
    assert computed < len(v) / 4 and scores[0][0] == np.delete(v @ v[5], 5).max()


def test_any_finite_components_and_lengths(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [20000.0, 0.0]), (2, [40000.0, 0.0])]
    assert found(spark.createDataFrame(rows, kind))[:2] == [(0, 1, 2, 163_840_000), (0, 2, 1, 81_920_000)]
    rng = random.Random(4)
    for size in (1e5, 3e7, 1e300):
        rows = [(i, [rng.uniform(-size, size) for _ in range(rng.choice([1, 3, 5]))]) for i in range(90)] + [(None, [1.0]), (20, [size]), (20, [-size])]
        assert found(spark.createDataFrame(rows, kind), tree_rows=64) == brute(rows, 20)
