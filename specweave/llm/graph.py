"""Connected components: local forests, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that one task joins up in memory.
EDGES = 200_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of each component, with that least node."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(back[: len(u)].tolist(), back[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    least = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _contract(batches):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        u, v = _forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list; component is its smallest node.

    First every task joins up about EDGES edges by itself, which leaves a forest of stars
    over them. Where that took several tasks, rounds hang neighbours onto the least node
    seen, with minima and joins only, so a node of any degree is pre-aggregated; a
    logarithmic number of rounds ends in stars.
    """
    x, y = F.col(a), F.col(b)
    e = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    tasks = -(-e.count() // EDGES)
    e = cut(e.coalesce(max(1, tasks)).mapInArrow(_contract, "u long, v long"))
    if tasks <= 1:
        return _named(e)
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return _named(e)
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where(F.col("u") != F.col("v")).distinct())


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
