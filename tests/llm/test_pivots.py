"""Exact search for the largest inner products against all products."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import pivots
from fieldspark.llm.queries import QUERIES


def plain(queries, rows, k):
    """queries and rows: (id, list or None)."""
    out = defaultdict(list)
    rows = [(i, np.array(v, object)) for i, v in rows if i is not None and v]
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and v}:
        v = np.array(v, object)
        scored = sorted((-int((v * x).sum()), i) for i, x in rows if i != q and len(x) == len(v))[:k]
        out[q] += [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return {q: sorted(x) for q, x in out.items() if x}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def asked(spark, rows, k=5, **more):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").selectExpr("*", "1 AS id", "2 AS cell", "3 AS d", "map('a', 1) AS q", "4 AS rank")
    queries = df.filter("vec_id % 7 = 0 OR vec_id IS NULL").withColumn("query_id", F.col("vec_id"))
    return found(pivots.top_products(queries, df, k=k, **more)), plain([x for x in rows if x[0] is None or x[0] % 7 == 0], rows, k)


@pytest.mark.parametrize("dims,together,count", [(6, 8192, 4), (6, 10, 56), (70, 8192, 56)])
def test_against_all_products(spark, dims, together, count):
    r = np.random.default_rng(dims)
    centres = r.integers(-60, 60, (5, dims))
    v = centres[r.integers(0, 5, 400)] + r.integers(-3, 4, (400, dims))
    v[:120] = v[0]  # one vector in many rows
    got, want = asked(spark, [(i - 50, v[i].tolist()) for i in range(400)], least=32, together=together, pivots=count)
    assert got == want


def test_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-9, 9, 4).tolist()) for i in range(60)]
    rows += [(None, [1, 2, 3, 4]), (7, None), (14, []), (21, [1, 2]), (22, [3, 4]), (23, [0, 0]), (7, [9, 9, 9, 9]), (7, [9, 9, 9, 9]), (8, [9, 9, 9, 9]), (8, [9, 9, 9, 9])]
    rows += [(70, [2**28, -(2**28), 2**28, 5]), (71, [2**28, 2**28, 2**28, 7]), (77, [0, 0, 0, 0]), (78, [-(2**29), 1, 1, 1])]
    for extra in ({}, {"sample": 1}, {"together": 3, "least": 4}):
        got, want = asked(spark, rows, **extra)
        assert got == want
    assert asked(spark, [(i, [1, 1]) for i in range(50)])[0] == plain([(i, [1, 1]) for i in range(0, 50, 7)], [(i, [1, 1]) for i in range(50)], 5)
    assert asked(spark, rows[:1]) == ({}, {})
    assert asked(spark, []) == ({}, {})


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.01],), (None,), ([1.0, None],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1e30, 1.0],), ([],)], "x array<float>")
    assert [r[0] for r in df.select(pivots.quantised(F.col("x"))).collect()] == [[32, -1], None, None, None, None, None, []]


def test_bounds_hold_and_leave_rows_out():
    """No score exceeds its bound; near groups, most rows are never evaluated."""
    r = np.random.default_rng(9)
    v = (r.integers(-50, 50, (20, 32))[r.integers(0, 20, 2000)] + r.integers(-2, 3, (2000, 32))).astype(np.int64)
    p = pivots.Pivots(pivots.pick_pivots(v.astype(float), 24))
    block = pivots.Block(np.arange(2000), v, p.distances(v.astype(float)), p)
    bound = block.inside[:50] @ block.inside.T + np.outer(block.outside[:50], block.outside) + 1e-3
    assert (v[:50] @ v.T <= bound).all()
    best = -np.sort(-(v[:50] @ v.T), axis=1)[:, 20]
    assert (bound >= best[:, None]).mean() < 0.1


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, float)).astype(int).tolist()) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(QUERIES["op11_top_products"](spark, folder)) == plain([x for x in rows if x[0] % 20 == 0], rows, 20)
