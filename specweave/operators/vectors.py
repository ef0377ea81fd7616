"""Exact nearest vectors at size: cells around pivots, skipped by the triangle inequality.

Vectors of length 1 are at distance sqrt(2 - 2 cos). A sample of them are pivots; each vector
belongs to its nearest pivot and, by quantiles of the distance to it, to a ring. Pivot and ring
are a cell, and a cell of many rows is dealt into parts. All that is known of cells (at most
``PIVOTS * RINGS`` of them) is the least and greatest distance to their pivot and their rows, so
it may be collected. For a query at distance d of a pivot no vector of a ring [low, high] is nearer than
d - high or low - d.

Cells are put together into groups of about ``part_rows`` rows. Every query first meets the
groups of the cells that can be nearest until they hold as many rows as are asked for; the
worst of the best so far is its radius, and then it meets the groups of all cells that may
reach into it, and in them only those cells. A query goes once to a group, not once to
each of its cells. Queries and rows meet by a grouping on (group, part, block of queries), so
no task holds more than a part of a group and a block of queries, and nothing is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut
from .retrieval import SCORES, TOP, best_of, near_pairs, ranked, unit

PIVOTS, RINGS = 4096, 16
#: Rows of a part of a group, and queries of a block.
PART_ROWS, BLOCK = 8192, 4096
#: Scores are rounded to six places; distances are compared with this to spare.
_SLACK = 2e-5


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of unit vectors; the exact zero vector counts as one at distance 1 of its own place."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _blocks(n: int, across: int):
    """Slices of n rows of which each makes at most SCORES numbers with ``across`` others."""
    step = max(1, SCORES // max(1, across))
    return (slice(a, a + step) for a in range(0, n, step))


class Cells:
    """Vectors dealt into cells: rows (key, vector, cell, bin, part), and what is known of the cells."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, part_rows: int = PART_ROWS) -> None:
        self.key, self.vector, self.kind = key, vector, vectors.schema[key].dataType.simpleString()
        n = vectors.count()
        most = min(PIVOTS, pivots or max(1, math.isqrt(n) // 2))
        drawn = vectors.orderBy(F.xxhash64(key), key).limit(most).select(vector).toPandas()
        self.pivots = centres = unit(drawn[vector])

        def place(batches):
            for b in batches:
                x, near, far = unit(b[vector]), np.zeros(len(b), np.int32), np.zeros(len(b))
                for at in _blocks(len(b), len(centres)):
                    d = _distances(x[at], centres)
                    near[at], far[at] = d.argmin(1), d.min(1)
                yield pd.DataFrame({key: b[key], vector: b[vector], "pivot": near, "d": far})

        each = vectors.select(key, vector)
        placed = cut(each.mapInPandas(place, f"{each._jdf.schema().toDDL()}, pivot int, d double")) if n else None
        if placed is None:
            self.rows, self.known = each.select("*", F.lit(0).alias("cell"), F.lit(0).alias("bin"), F.lit(0).alias("part")), pd.DataFrame({"cell": [], "low": [], "high": [], "n": [], "bin": []})
            return
        steps = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
        rings = placed.groupBy("pivot").agg(F.percentile_approx("d", steps, 1000).alias("bounds"))  # a row a pivot
        ring = F.size(F.filter("bounds", lambda x: x < F.col("d")))
        rows = placed.join(F.broadcast(rings), "pivot").select(key, vector, "d", (F.col("pivot") * RINGS + ring).alias("cell"))
        known = rows.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n"))
        self.known = known = known.orderBy("cell").toPandas()
        # neighbouring cells make a group while they hold no more than part_rows together; a larger cell is one, in parts
        bins, held = np.zeros(len(known), np.int32), 0
        for i, n in enumerate(known["n"]):
            new = i > 0 and held + n > part_rows
            bins[i] = bins[i - 1] + new if i else 0
            held = n if new else held + n
        known["bin"] = bins
        self.groups = known.groupby("bin", as_index=False)["n"].sum()
        self.groups["parts"] = -(-self.groups["n"] // part_rows)
        told = known[["cell", "bin"]].merge(self.groups[["bin", "parts"]], on="bin").astype("int32")
        told = F.broadcast(vectors.sparkSession.createDataFrame(told, "cell int, bin int, parts int"))
        self.rows = cut(rows.withColumn("cell", F.col("cell").cast("int")).join(told, "cell").select(key, vector, "cell", "bin", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part")))

    def _visits(self, queries: DataFrame, top: int, radius: bool) -> DataFrame:
        """(query_id, q, reach, least, bin, n) of the groups that queries meet, n of whose rows they look at.

        First the groups of cells that can be nearest, whole; or (with columns reach and least) all with cells that reach into it.
        """
        known, centres, vector = self.known.reset_index(drop=True), self.pivots, self.vector
        cell, low, high, held, bins = (known[c].to_numpy() for c in ("cell", "low", "high", "n", "bin"))
        starts = np.nonzero(np.r_[True, bins[1:] != bins[:-1]])[0]  # cells of a group lie side by side

        def run(batches):
            for b in batches:
                q, ids = unit(b[vector]), b["query_id"].to_numpy()
                reach = b["reach"].to_numpy() if radius else np.full(len(b), 3.0)
                least = b["least"].to_numpy() if radius else np.full(len(b), -np.inf)
                for at in _blocks(len(b), len(cell)):
                    d = _distances(q[at], centres)[:, cell.astype(int) // RINGS]
                    bound = np.maximum(np.maximum(d - high, low - d), 0)
                    if radius:
                        meets = bound <= reach[at][:, None] + _SLACK
                        n = np.add.reduceat(np.where(meets, held, 0), starts, axis=1)
                    else:
                        # the first cells that together hold as many rows as are asked for; of those as near the ones around nearer pivots
                        order = np.lexsort((d, bound), axis=1)
                        enough = np.cumsum(held[order], axis=1) - held[order] < top
                        meets = np.zeros(bound.shape, bool)
                        np.put_along_axis(meets, order, enough, 1)
                        n = np.broadcast_to(np.add.reduceat(held, starts), (len(d), len(starts)))
                    who, which = np.nonzero(np.logical_or.reduceat(meets, starts, axis=1))
                    told = {"query_id": ids[at][who], vector: b[vector].to_numpy()[at][who], "reach": reach[at][who], "least": least[at][who]}
                    yield pd.DataFrame({**told, "bin": bins[starts][which].astype(np.int32), "n": n[who, which].astype(np.int64)})

        kind = queries.schema["query_id"].dataType.simpleString(), queries.schema[vector].dataType.simpleString()
        return queries.mapInPandas(run, f"query_id {kind[0]}, {vector} {kind[1]}, reach double, least double, bin int, n long")

    def _best(self, visits: DataFrame, top: int, block: int) -> DataFrame:
        """(query_id, key, score): of each visit the best rows of every part of the group."""
        key, vector, centres = self.key, self.vector, self.pivots
        ends = {c: (low, high) for c, low, high in self.known[["cell", "low", "high"]].itertuples(index=False)}
        asked = visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # a row a group
        asked = F.broadcast(asked)
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        groups = visits.sparkSession.createDataFrame(self.groups[["bin", "parts"]].astype("int32"), "bin int, parts int")
        left = visits.join(asked, "bin").join(F.broadcast(groups), "bin").select("query_id", vector, "reach", "least", "bin", parts, F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"))
        right = self.rows.join(asked, "bin").select(key, vector, "cell", "bin", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        kind = visits.schema["query_id"].dataType.simpleString()

        def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            ids, out = q["query_id"].to_numpy(), []
            if len(q) and len(x):
                asked, held, cells, keys = unit(q[vector]), unit(x[vector]), x["cell"].to_numpy(), x[key].to_numpy()
                reach, least = q["reach"].to_numpy() + _SLACK, q["least"].to_numpy().copy()
                for c in np.unique(cells):
                    d, (low, high) = _distances(asked, centres[c // RINGS][None, :])[:, 0], ends[c]
                    who, of = np.nonzero(np.maximum(d - high, low - d) <= reach)[0], cells == c
                    i, k, s = near_pairs(asked[who], held[of], keys[of], least[who], top)
                    out.append((who[i], k, s))
            i, k, s = best_of(*map(np.concatenate, zip(*out, strict=True)), top) if out else (np.zeros(0, int), x[key].to_numpy()[:0], np.zeros(0))
            return pd.DataFrame({"query_id": ids[i], key: k, "score": s})

        by = ["bin", "part", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, f"query_id {kind}, {key} {self.kind}, score double")

    def _passes(self, queries: DataFrame, top: int, block: int) -> tuple[DataFrame, DataFrame]:
        q = cut(queries.select(F.col(self.key).alias("query_id"), self.vector))
        first = cut(self._visits(q, top, False))
        early = ranked(self._best(first, top, block), "query_id", "score", self.key, top)
        # a query that has not yet met as many rows as are asked for meets all cells
        full, last = F.count(F.lit(1)) >= top, F.min("score")
        reach = F.when(full, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * last))).otherwise(F.lit(3.0))
        known = cut(early.groupBy("query_id").agg(reach.alias("reach"), F.when(full, last).otherwise(F.lit(float("-inf"))).alias("least")))
        return first, cut(self._visits(q.join(known, "query_id"), top, True))

    def search(self, queries: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
        """(query_id, key, score, rank) by exact cosine, of queries with the vectors' columns."""
        if not len(self.known):
            nothing = queries.select(F.col(self.key).alias("query_id"), F.col(self.key), F.lit(0.0).alias("score")).limit(0)
            return ranked(nothing, "query_id", "score", self.key, top)
        _, every = self._passes(queries, top, block)
        return ranked(self._best(every, top, block), "query_id", "score", self.key, top)

    def met(self, queries: DataFrame, top: int = TOP, block: int = BLOCK) -> dict[str, int]:
        """Pairs of a query and a vector there are, and those whose score is worked out."""
        first, every = self._passes(queries, top, block)
        met = first.select("n").union(every.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return {"pairs": int(queries.count() * self.known["n"].sum()), "met": met}
