"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, A-Z read as a-z. Windows
of ``MIN_TILE`` tokens of documents and test items are joined by Karp-Rabin hashes as
seeds; seeds on one diagonal that follow each other are a longer match. The longest
match that touches no marked token is marked as a tile on both sides, again and again;
so passages count in whatever order they stand. A document is contaminated by an item if
its tiles cover ``COVER`` of the item's tokens.

Where documents and items share so many windows that their pairs would not fit in memory
(few words over and over), a document and an item are tiled by running Karp-Rabin itself:
the greatest length at which unmarked windows of both have a hash in common is searched by
halving. That holds no more than the two texts, and gives the same tiles.

The test items are a stated query set: they go to every document in blocks of at most
``BLOCK_BYTES`` of text, a pass over the documents for each block, however many there are.

Defined cases: null and empty texts, on either side, match nothing; items of fewer than
MIN_TILE tokens are never matched (they say too little); repeated documents are judged
one by one, and repeated items too; a null doc_id or item_id is carried along; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WORD, mix, powers, prepare, table, text_chunks, word_hashes, words

MIN_TILE = 5
COVER = 0.5
BLOCK_BYTES = 4 << 20
#: Seeds that are held at once.
SEEDS = 1 << 20

_U = np.uint64
_I = np.int64
_STEP = _U(0xC2B2AE3D27D4EB4F)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(buf, off, NOT_WORD)
    return word_hashes(buf, starts, ends), first


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each k tokens, running on by one token at a time for the whole array at once."""
    out = np.zeros(max(len(h) - k + 1, 0), _U)
    for j in range(k):
        out = out * _STEP + h[j : j + len(out)]
    return mix(out)


def tile(item_at: np.ndarray, doc_at: np.ndarray, k: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, tokens) from seeds: equal windows of k tokens.

    Seeds that touch a marked token are dropped, so each turn sees only free ones; equal
    lengths go by their place in the item, then in the document.
    """
    tiles = []
    order = np.lexsort((item_at, doc_at - item_at))
    i, d = item_at[order], doc_at[order]
    while len(i):
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 1) | (np.diff(d) != 1)
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(i)))
        best = int(run.max())
        longest = head[run == best]
        at = longest[np.lexsort((d[longest], i[longest]))[0]]
        n, a, b = best + k - 1, int(i[at]), int(d[at])
        tiles.append((a, b, n))
        free = ((i + k <= a) | (i >= a + n)) & ((d + k <= b) | (d >= b + n))
        i, d = i[free], d[free]
    return tiles


def tile_by_lengths(item: np.ndarray, doc: np.ndarray, k: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """The tiles that tile() finds, from token hashes, in memory that grows with the two texts alone."""
    p, q = powers(max(len(item), len(doc)) + 1)
    sums = [np.concatenate(([_U(0)], np.cumsum(h * p[: len(h)], dtype=_U))) for h in (item, doc)]
    marked = [np.zeros(len(h) + 1, _I) for h in (item, doc)]  # marked tokens before each place

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of unmarked windows of n tokens."""
        m, x = marked[side], sums[side]
        at = np.flatnonzero(m[n:] == m[: len(m) - n])
        return at, mix((x[at + n] - x[at]) * q[at])

    def common(n: int) -> tuple[int, int] | None:
        """The first place in the item whose window the document has, and the first there."""
        (at, g), (to, h) = windows(0, n), windows(1, n)
        there = np.flatnonzero(np.isin(g, h))
        return (int(at[there[0]]), int(to[np.flatnonzero(h == g[there[0]])[0]])) if len(there) else None

    tiles, top = [], min(len(item), len(doc))
    while top >= k and (found := common(k)):
        low, high = k, top  # the longest is never longer than the one before
        while low < high:
            n = (low + high + 1) // 2
            if at := common(n):
                low, found = n, at
            else:
                high = n - 1
        a, b = found
        tiles.append((a, b, low))
        top = low
        for m, at in zip(marked, (a, b), strict=True):
            m[at + 1 :] += np.minimum(np.arange(1, len(m) - at), low)
    return tiles


class Items:
    """Windows of a block of test items, sorted by hash."""

    def __init__(self, texts: list[str | None], k: int = MIN_TILE) -> None:
        self.k, self.tokens = k, []
        grams, owner, place = [], [], []
        for n, t in enumerate(texts):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            h, _ = tokens(raw, np.array([0, len(raw)]))
            self.tokens.append(h)
            g = window_hashes(h, k)
            grams.append(g)
            owner.append(np.full(len(g), n, _I))
            place.append(np.arange(len(g)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        g, self.owner, self.place = join(grams, _U), join(owner, _I), join(place, _I)
        order = np.argsort(g, kind="stable")
        self.grams, self.owner, self.place = g[order], self.owner[order], self.place[order]
        self.sizes = [len(h) for h in self.tokens]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams >> _U(44)).astype(_I)] = True

    def _may(self, place: np.ndarray, size: int, cover: float) -> bool:
        """Whether an item's windows at these places cover enough of it, all together."""
        most = np.unique(place)
        return int(np.minimum(np.diff(np.append(most, most[-1] + self.k)), self.k).sum()) >= cover * size

    def hits(self, buf: np.ndarray, off: np.ndarray, cover: float, seeds: int | None = None):
        """(row, item, tiles, covered tokens) of contaminated rows."""
        h, first = tokens(buf, off)
        g = window_hashes(h, self.k)
        at = np.flatnonzero(self.maybe[(g >> _U(44)).astype(_I)])
        lo, hi = np.searchsorted(self.grams, g[at], "left"), np.searchsorted(self.grams, g[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + self.k <= first[row + 1]
        at, lo, n, row = at[inside], lo[inside], n[inside], row[inside]
        # rows go on together while their seeds fit
        seeds, edge = seeds or SEEDS, np.flatnonzero(np.diff(row, prepend=-1, append=-2))
        held = np.concatenate(([0], np.cumsum(n)))
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(held[edge], held[edge[i]] + seeds, "right")) - 1)
            s = slice(edge[i], edge[j])
            if held[edge[j]] - held[edge[i]] > seeds:
                r = int(row[edge[i]])
                yield from self._large(r, h[first[r] : first[r + 1]], g[at[s]], cover)
            else:
                yield from self._tiled(at[s], row[s], lo[s], n[s], first, cover)
            i = j

    def _tiled(self, at: np.ndarray, row: np.ndarray, lo: np.ndarray, n: np.ndarray, first: np.ndarray, cover: float):
        seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, row, owner, place = np.repeat(at - first[row], n), np.repeat(row, n), self.owner[seed], self.place[seed]
        order = np.lexsort((owner, row))
        at, row, owner, place = at[order], row[order], owner[order], place[order]
        edge = np.flatnonzero((np.diff(row) != 0) | (np.diff(owner) != 0)) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.append(edge, len(row)), strict=True):
            size = self.sizes[owner[a]]
            if self._may(place[a:b], size, cover):
                yield from self._found(int(row[a]), int(owner[a]), tile(place[a:b], at[a:b], self.k), cover)

    def _large(self, row: int, doc: np.ndarray, grams: np.ndarray, cover: float):
        """The items of one document whose seeds are too many to hold, one by one."""
        shared = np.flatnonzero(np.isin(self.grams, grams))
        owner, place = self.owner[shared], self.place[shared]
        order = np.argsort(owner, kind="stable")
        for item in np.unique(owner).tolist():
            mine = place[order][np.searchsorted(owner[order], item) : np.searchsorted(owner[order], item, "right")]
            if len(mine) and self._may(mine, self.sizes[item], cover):
                yield from self._found(row, int(item), tile_by_lengths(self.tokens[item], doc, self.k), cover)

    def _found(self, row: int, item: int, tiles: list[tuple[int, int, int]], cover: float):
        covered = sum(t[2] for t in tiles)
        if covered >= cover * self.sizes[item]:
            yield row, item, len(tiles), covered


def _blocks(items: DataFrame, limit: int) -> DataFrame:
    """items with block, a number; a block's texts hold limit bytes or little more."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    n = (items.agg(F.sum(size)).first()[0] or 0) // limit + 1
    if n == 1:
        return items.withColumn("block", F.lit(0))
    # blocks by hash are filled evenly but for chance, and cut again where a limit is passed
    spread = items.withColumn("cell", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    within = W.partitionBy("cell").orderBy("item_id", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    return spread.withColumn("block", F.col("cell") * (1 << 20) + F.floor((F.sum(size).over(within) - 1) / limit)).drop("cell")


def contaminated(docs: DataFrame, items: DataFrame, min_tile: int = MIN_TILE, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, n_tokens (of the item), coverage of contaminated documents."""
    spark = docs.sparkSession
    prepare(spark)
    items = _blocks(items.select("item_id", "text"), block_bytes)
    kinds = [r[0] for r in items.select("block").distinct().collect()]  # a number for every few MB of test items
    docs = docs.select("doc_id", "text")
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, n_tiles long, covered long, n_tokens long"
    out = None
    for kind in kinds:
        part = items.where(F.col("block") == kind).orderBy("item_id", "text").collect()
        ids, found = [r["item_id"] for r in part], Items([r["text"] for r in part], min_tile)
        one = docs.mapInArrow(_matcher(ids, found, cover), schema)
        out = one if out is None else out.union(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("coverage", F.col("covered") / F.col("n_tokens"))


def _matcher(ids: list, found: Items, cover: float):
    def run(batches):
        for b in batches:
            rows, items, n, covered, sizes = [], [], [], [], []
            for lo, _, buf, off in text_chunks(b.column(1)):
                for row, item, tiles, c in found.hits(buf, off, cover):
                    rows.append(lo + row)
                    items.append(ids[item])
                    n.append(tiles)
                    covered.append(c)
                    sizes.append(found.sizes[item])
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(items, pa.int64() if all(isinstance(x, (int, type(None))) for x in items) else None), *(pa.array(x, pa.int64()) for x in (n, covered, sizes))], ["doc_id", "item_id", "n_tiles", "covered", "n_tokens"])

    return run


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
