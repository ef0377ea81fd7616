"""Cells of vectors: what is found is what a look at all pairs finds, and cells are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.operators import retrieval, vectors


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def _clusters(n=600, size=8, kinds=12):
    rng = np.random.default_rng(3)
    return rng.normal(size=(kinds, size))[rng.integers(0, kinds, n)] + 0.05 * rng.normal(size=(n, size))


def _want(x, ids, top):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = []
    for i in ids:
        s = np.round(u[i] @ u.T, 6)
        order = np.lexsort((np.arange(len(x)), -s))[:top]
        out += [(i, int(k), r) for r, k in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 10, 700])
def test_cells_find_the_nearest_of_all(spark, top):
    x = _clusters()
    x[5] = 0
    x[100:300] = x[100]  # a third of all rows are copies
    rows = _frame(spark, x)
    cells = vectors.Cells(rows, pivots=12, part_rows=50)
    queries = rows.where("vec_id % 50 = 0")
    got = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in cells.search(queries, top, block=5).collect())
    assert got == _want(x, range(0, 600, 50), top)
    if top == 10:
        met = cells.met(queries, top)
        assert met["pairs"] == 12 * 600 and met["met"] < 0.6 * met["pairs"]
        held = cells.rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        assert held < 120


def test_large_query_sets_meet_cells(spark):
    x = _clusters(200)
    rows = _frame(spark, x)
    one = retrieval.vector_top(rows.where("vec_id % 10 = 0"), rows, top=5)
    many = retrieval.vector_top(rows.where("vec_id % 10 = 0"), rows, top=5, block_bytes=8 * 8 * 3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_no_vectors_and_no_queries(spark):
    rows = _frame(spark, _clusters(20))
    assert vectors.Cells(rows).search(rows.limit(0), 3).count() == 0
    assert vectors.Cells(rows.limit(0)).search(rows, 3).count() == 0
    assert retrieval.vector_top(rows.limit(0), rows).count() == 0


def test_products_are_held_a_block_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(5)
    q, x = retrieval.unit(_series(rng.normal(size=(6000, 4)))), retrieval.unit(_series(rng.normal(size=(5000, 4))))
    tracemalloc.start()
    who, ids, scores = retrieval.near_pairs(q, x, np.arange(5000), np.full(6000, -np.inf), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # all products are 240 MB
    assert len(who) == 6000 * 3 and (np.diff(scores.reshape(-1, 3)) <= 0).all()


def test_a_query_goes_once_to_a_group_of_cells(spark):
    rows = _frame(spark, np.random.default_rng(7).normal(size=(600, 8)))
    cells = vectors.Cells(rows, pivots=12, part_rows=200)
    first, every = cells._passes(rows.where("vec_id % 50 = 0"), 10, 5)
    assert len(cells.known) > 100 and cells.groups["bin"].max() < 6
    for visits in (first, every):
        assert visits.count() == visits.select("query_id", "bin").distinct().count() <= 12 * len(cells.groups)


def _series(x):
    import pandas as pd

    return pd.Series(list(x))
