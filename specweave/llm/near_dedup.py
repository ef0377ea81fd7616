"""MinHash near-dedup with tensored banding.

Two small collections of M band keys (R minhashes each) are computed for every set of
five-word shingles. The M * M tables of the search are keyed by pairs, one key of either
collection, so 2 * M * R minhashes serve tables that would take 2 * M * M * R of them on
their own. A pair of similarity s meets in some table with chance
(1 - (1 - s**R)**M)**2: 0.9995 at 0.75, 0.99999 at 0.85. The pairing also saves rows:
only band keys that two sets share are paired up.

Documents of equal sets are one node. In each bucket of a table every node is first
verified, on full sets, against the bucket's least node; nodes found linked are joined
up. Buckets that still hold several components are searched again, in blocks of bounded
size: every node's partners are ranked by the similarity of sketches, and rounds verify
those of ranks 0 to 7 and then all others that are not in the node's component by then.
Pairs whose sketches lie more than ``DEVIATIONS`` standard deviations below the similarity
asked for are left out without a look at their sets: a linked pair is lost so with chance
4e-6 or less, beside the tables' own. All others between components are verified, and yet
a group of thousands of copies takes a few checks a member. A verified head's text goes once
to every ``HEAD_ROWS`` of its partners. Links make components by alternating stars, all as
tables.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing
and kept; texts of one to four words have one shingle, their sequence of words; rows
that share a doc_id count as one node, with the set of least hash where their sets differ
(n_shingles stays each row's own, rows without words stay by themselves); a null doc_id has no component (null, kept is
false); further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot, mix, prepare, shingles, store, table, text_chunks, trim, word_hashes, words
from .graph import components

WORDS = 5
PERCENT = 75
#: Band keys of each of the two collections, and minhashes of a band key.
M, R = 10, 2
#: Nodes of a bucket that are compared with each other in memory at once.
BLOCK = 1024
#: Bins of a sketch: the least shingle hash of each, by one permutation, as a byte.
BINS = 256
#: A pair is verified unless its sketches are more standard deviations than these below the similarity asked for.
DEVIATIONS = 4.5
#: First rank of each round; the last goes on to the end.
RANKS = (0, 8)
#: Partners that one copy of a head's text serves.
HEAD_ROWS = 256

_U = np.uint64
_N = 2 * M * R


def _constants() -> tuple[np.ndarray, np.ndarray]:
    c = mix(np.arange(1, 2 * _N + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return c[:_N], c[_N:] | _U(1)


def minhashes(val: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x (2 M R) minhashes of the sets val[first[i]:first[i + 1]], none of them empty."""
    out = np.empty((len(first) - 1, _N), _U)
    for i, (c, a) in enumerate(zip(*_constants(), strict=True)):
        x = (val ^ c) * a
        x ^= x >> _U(31)
        x *= a
        out[:, i] = np.minimum.reduceat(x, first[:-1])
    return out


def _band_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two collections: rows x M keys each."""
    bands = h.reshape(len(h), 2 * M, R)
    key = np.zeros(bands.shape[:2], _U)
    for r in range(R):
        key = mix(key * _U(0xFF51AFD7ED558CCD) + bands[:, :, r])
    return key[:, :M], key[:, M:]


def sets(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and the first of each (n + 1)."""
    starts, ends, first = words(buf, off)
    return shingles(word_hashes(buf, starts, ends), first, k)


def sketches(val: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x BINS: a byte of the least hash in each bin, 0 for an empty bin. Hashes are sorted within a row."""
    out = np.zeros((len(first) - 1, BINS), np.uint8)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bin_ = (val >> _U(56)).astype(np.int64)
    head = np.ones(len(val), bool)
    head[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
    out[row[head], bin_[head]] = (val[head] % _U(255)).astype(np.uint8) + 1
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a hash of the text, two of the set, the band keys u and v, and a sketch."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(1)):
                val, first = sets(buf, off)
                n = np.diff(first)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
                u = v = np.zeros((0, M), _U)
                sketch = np.zeros((0, BINS), np.uint8)
                if len(full):
                    at = first[:-1][full]
                    s1[full], s2[full] = np.add.reduceat(mix(val + _U(0x1234567)), at), np.add.reduceat(mix(val * _U(0x2545F4914F6CDD1D) + _U(99)), at)
                    at = np.append(at, len(val))
                    u, v = _band_keys(minhashes(val, at))
                    sketch = sketches(val, at)
                each = np.zeros(len(n) + 1, np.int32)
                each[1:] = np.cumsum(n > 0)
                lists = [pa.ListArray.from_arrays(pa.array(each * M), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))) for x in (u, v)]
                bytes_ = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((each * BINS).astype(np.int32).tobytes()), pa.py_buffer(sketch.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), b.column(2).slice(lo, hi - lo), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), *lists, bytes_], ["doc_id", "n_shingles", "mark", "s1", "s2", "u", "v", "sketch"])
        trim()

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, n_shingles long, mark long, s1 long, s2 long, u array<long>, v array<long>, sketch binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, i, j, rep) of every table (i, j) and node, for pairs of band keys that other nodes share."""

    each = nodes.select("rep", F.posexplode(F.concat("u", "v")).alias("i", "k"))
    twice = each.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "k")
    keys = each.join(twice, ["i", "k"], "left_semi").groupBy("rep").agg(F.collect_list(F.struct("i", "k")).alias("keys"))  # 2 * M at most
    both = keys.select("rep", F.filter("keys", lambda x: x["i"] < M).alias("u"), F.transform(F.filter("keys", lambda x: x["i"] >= M), lambda x: F.struct((x["i"] - M).alias("i"), x["k"].alias("k"))).alias("v"))
    pairs = both.select("rep", F.explode("u").alias("a"), "v").select("rep", "a", F.explode("v").alias("b"))
    return pairs.select(F.xxhash64("a.i", "b.i", "a.k", "b.k").alias("key"), F.col("a.i").cast("byte").alias("i"), F.col("b.i").cast("byte").alias("j"), "rep")


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union.

    Partners follow their head in a sorted stream, so a task holds one head's set. Heads of
    many partners are dealt over several streams.
    """
    held = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    streams = hot(held, pairs.count(), HEAD_ROWS).select("a", F.ceil(F.col("n") / HEAD_ROWS).alias("streams"))
    p = pairs.join(F.broadcast(streams), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("streams")), F.lit(0)).alias("stream"))
    t = texts.select("rep", "text").hint("merge")
    partners = p.join(t.withColumnRenamed("rep", "b"), "b").select("a", "stream", F.col("b").alias("node"), "text")
    heads = p.select("a", "stream").distinct().join(t.withColumnRenamed("rep", "a"), "a").select("a", "stream", F.lit(None).cast("long").alias("node"), "text")
    rows = partners.union(heads).repartition("a", "stream").sortWithinPartitions("a", "stream", F.col("node").asc_nulls_first())

    def run(batches):
        head = np.zeros(0, _U)
        for batch in batches:
            a, b, good = batch.column(0).to_numpy(), batch.column(2), np.zeros(batch.num_rows, bool)
            leads = np.asarray(b.is_null())
            for lo, hi, buf, off in text_chunks(batch.column(3)):
                val, first = sets(buf, off)
                for i in range(lo, hi):
                    x = val[first[i - lo] : first[i - lo + 1]]
                    if leads[i]:
                        head = x.copy()
                    elif 100 * min(len(x), len(head)) >= percent * max(len(x), len(head)):
                        both = len(x) + len(head) - len(np.union1d(x, head))
                        good[i] = 100 * both >= percent * (len(x) + len(head) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), b.filter(pa.array(good))], ["a", "b"])
        trim()

    return rows.mapInArrow(run, "a long, b long")


def _close(p: np.ndarray, q: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of sketches p and q, and whether the sets, of so many shingles in all, may be similar enough.

    The bins that are filled draw so many shingles of the union without replacement. If the
    sets are just similar enough the union's size follows from theirs, so small sets, hardly
    a shingle of which is hidden, are told apart almost exactly.
    """
    s = PERCENT / 100
    filled = np.maximum(((p > 0) | (q > 0)).sum(1), 1)
    close = ((p == q) & (p > 0)).sum(1) / filled
    hidden = np.clip(1 - filled * (1 + s) / np.maximum(sizes, 1), 0, 1)
    return close, close >= s - DEVIATIONS * np.maximum(np.sqrt(s * (1 - s) / filled * hidden), 0.004)


def _partners(table: tuple[int, int], left: np.ndarray, right: np.ndarray, rep: np.ndarray, comp: np.ndarray, bands: np.ndarray, sketch: np.ndarray, n: np.ndarray, low: int, high: float):
    """Pairs (a, b) of left with right whose rank, among left's partners, is in [low, high) and whose components differ.

    A pair that meets in several tables counts in the first of them only.
    """
    step = max(1, 32768 // max(len(right), 1))
    for lo in range(0, len(left), step):
        mine = left[lo : lo + step]
        here = np.ones((len(mine), len(right)), bool)
        for side, t in ((0, table[0]), (M, table[1])):
            for k in range(t + 1):
                same = bands[mine, side + k][:, None] == bands[right, side + k][None, :]
                here &= same if k == t else ~same
        here &= rep[mine][:, None] != rep[right][None, :]
        x, y = np.nonzero(here)
        if not len(x):
            continue
        close, may = _close(sketch[mine[x]], sketch[right[y]], n[mine[x]] + n[right[y]])
        x, y, close = x[may], y[may], close[may]
        order = np.lexsort((rep[right[y]], -close, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        rank = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        go = (rank >= low) & (rank < high) & (comp[mine[x]] != comp[right[y]])
        a, b = rep[mine[x[go]]], rep[right[y[go]]]
        yield np.minimum(a, b), np.maximum(a, b)


def _candidates(rows: DataFrame, low: int, high: float, block: int) -> DataFrame:
    """Distinct pairs (a, b) of these ranks between components of one bucket.

    rows: key, i, j, rep, component, n_shingles, bands, sketch, held (rows of the bucket). A bucket of
    many rows is dealt into blocks; each pair of blocks is a group of its own, of
    2 * block rows or so.
    """
    n = F.ceil(F.col("held") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "i", "j", "rep", "component", "n_shingles", "bands", "sketch")

    def pairs_of(c):
        key, p, q, own, i, j, rep, comp, n, bands, sketch = c
        left, right = np.flatnonzero(own == p[0]), np.flatnonzero(own == q[0])
        ways = [(left, right)] if p[0] == q[0] else [(left, right), (right, left)]
        for x, y in ways:
            yield from _partners((int(i[0]), int(j[0])), x, y, rep, comp, bands, sketch, n, low, high)

    def emit(found):
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(9)]
            cols += [np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint32).reshape(-1, 2 * M), np.frombuffer(b"".join(batch.column(10).to_pylist()), np.uint8).reshape(-1, BINS)]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held is not None else cols
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            if len(edge):
                yield emit([f for lo, hi in zip(np.concatenate(([0], edge[:-1])), edge, strict=True) for f in pairs_of([c[lo:hi] for c in cols])])
            held = [c[edge[-1] if len(edge) else 0 :] for c in cols]
        if held is not None and len(held[0]):
            yield emit(list(pairs_of(held)))
        trim()

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long").distinct()


def _bands() -> F.Column:
    """Low halves of all band keys, packed into bytes of the executors' order."""

    @F.pandas_udf("binary")
    def pack(u, v):
        return pd.Series([np.concatenate((a, b)).astype(np.int64).view(np.uint64).astype(np.uint32).tobytes() for a, b in zip(u, v, strict=True)], dtype=object)

    return pack("u", "v")


def _kept(df: DataFrame, name: str = "cut") -> DataFrame:
    """A stored table for merge joins: it grows with the documents, and its compressed size says nothing about memory."""
    return store(df, name).hint("merge")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    spark = docs.sparkSession
    sig = _kept(signatures(docs), "signatures")
    mine = F.struct("s1", "s2", "n_shingles", "mark")
    one = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(mine).alias("x"), F.max(mine).alias("y"), F.count(F.lit(1)).alias("times"))
    one = _kept(one.select("doc_id", "x.*", "times", (F.col("x") != F.col("y")).alias("several")))
    group = _kept(one.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "mark", "times")).alias("x"), F.count(F.lit(1)).alias("held")).select("s1", "s2", "n_shingles", F.col("x.doc_id").alias("rep"), "x.mark", "x.times", "held"))
    nodes = sig.where("n_shingles > 0").join(group.select(F.col("rep").alias("doc_id"), "mark"), ["doc_id", "mark"], "left_semi").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])
    bucket = _kept(_buckets(nodes))
    head = bucket.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.min(F.struct("i", "j", "key")).alias("table"), F.count(F.lit(1)).alias("held"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")).where("a < z")
    # of buckets that hold the same nodes only that of the first table is searched
    first = F.min("table").over(W.partitionBy("a", "z", "held", "members"))
    head = _kept(head.withColumn("first", first).select("key", "a", "held", (F.col("table") == F.col("first")).alias("searched")))
    bucket = _kept(bucket.join(head, "key"))
    near = bucket.select(F.col("rep").alias("doc_id")).distinct()
    near = _kept(near.join(group.select(F.col("rep").alias("doc_id"), "mark", "times"), "doc_id"))
    texts = _kept(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(near, ["doc_id", "mark"]).select(F.col("doc_id").alias("rep"), "text", "times"), "texts")
    texts = texts.where("times = 1").union(texts.where("times > 1").dropDuplicates(["rep"]))
    slim = _kept(nodes.join(near.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select("rep", "n_shingles", _bands().alias("bands"), "sketch"), "sketches")
    stars = _kept(bucket.where("rep > a").select("a", F.col("rep").alias("b")).distinct())
    parts = components(_kept(verify(stars, texts)))
    for low, high in zip(RANKS, (*RANKS[1:], float("inf")), strict=True):
        placed = bucket.where("searched").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        rest = placed.join(several, "key", "left_semi").join(slim, "rep")
        more = _kept(_candidates(rest, low, high, block).join(stars, ["a", "b"], "left_anti"))
        good = _kept(verify(more, texts))
        if not good.isEmpty():
            parts = components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(good))
    parts = parts.select(F.col("node").alias("rep"), F.col("component"))
    named = group.join(parts, "rep", "left").where("held > 1 or component is not null").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    # rows of one doc_id and other sets go where the chosen one goes
    moved = one.where("several").select("doc_id", F.struct("s1", "s2", "n_shingles").alias("to"))
    out = sig.select("doc_id", F.col("n_shingles").alias("own"), F.struct("s1", "s2", "n_shingles").alias("of")).join(moved, "doc_id", "left")
    out = out.select("doc_id", "own", F.inline(F.array(F.when(F.col("own") > 0, F.coalesce("to", "of")).otherwise(F.col("of"))))).join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("own").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
  FROM d),
x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
"""
