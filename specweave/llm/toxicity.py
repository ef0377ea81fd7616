"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training rows are those of ``labels`` whose crc32(doc_id as text) mod 3 is not 1, up
to ``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` of text, drawn in the order of a hash of
doc_id, toxic and clean ones by their shares. Texts above ``TRAIN_TEXT`` come last, the
shortest first, so none of them keeps another out; one above ``TRAIN_BYTES`` is scored
but never learned from. The lexicon (words and word beginnings that far more toxic than clean documents
hold), the trees and the isotonic curve are fitted by folds, so that no step learns from
what an earlier one has learned by heart. The model is below a few hundred KB; scoring
is one pass over whole texts, without a shuffle.

Features: densities of lexicon words and beginnings, their weights, hits near a word of
the second person, capitals, punctuation, obfuscation (letters mixed with digits, long
runs of one byte, words broken by signs) and length. Digits that stand for letters are
read as those letters when the lexicon is looked up.

Defined cases: null and empty texts get the features of an empty text and a score; with
no toxic or no clean training row every score is the share of toxic ones (0 without
rows); rows that repeat a doc_id are scored alike; a null doc_id counts as the text ''
for held_out; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, Spans, prepare, table, text_chunks, trim, words

TRAIN_ROWS = 8_000
TRAIN_BYTES = 12 << 20
#: Texts of up to so many bytes are drawn before all longer ones.
TRAIN_TEXT = 1 << 17
THRESHOLD = 0.7
FOLDS = 4
#: Lengths in bytes of the word beginnings that the lexicon may hold; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 8)
LEXICON = 1500
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
FEATURES = 20

#: Letters, with digits read as the letters they resemble.
_FOLD = LOWER.copy()
for _digit, _letter in zip(b"0134579", b"oieastg", strict=True):
    _FOLD[_digit] = _letter
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = ~NOT_WORD & ~_DIGIT
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"*#@$%&_~^+=|")] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:-'\"()")] = True


def _sum(row: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(row, weight, n).astype(np.float64)


def scan(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word starts, ends, first word of each row, and for each of BEGINNINGS the words' hashes (0: too short)."""
    starts, ends, first = words(buf, off, NOT_WORD)
    spans = Spans(_FOLD[buf])
    out = []
    for k in BEGINNINGS:
        h = spans.hashes(starts, np.minimum(starts + k, ends) if k else ends)
        out.append(np.where(ends - starts > k, h, np.uint64(0)) if k else h)
    return starts, ends, first, out


@dataclass
class Lexicon:
    """Sorted hashes and their log odds, one pair for each of BEGINNINGS."""

    keys: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64)] * len(BEGINNINGS))
    odds: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * len(BEGINNINGS))

    def look_up(self, k: int, h: np.ndarray) -> np.ndarray:
        keys = self.keys[k]
        if not len(keys):
            return np.zeros(len(h))
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(keys >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
        out = np.zeros(len(h))
        place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        out[at] = np.where(keys[place] == h[at], self.odds[k][place], 0.0)
        return out


def features(buf: np.ndarray, off: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """FEATURES columns, a row for each text."""
    n = len(off) - 1
    starts, ends, first, hashes = scan(buf, off)
    row = np.repeat(np.arange(n), np.diff(first))
    n_words, size = np.diff(first).astype(float), np.diff(off).astype(float)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(size, 1)
    row_of = lambda at: np.searchsorted(off, at, side="right") - 1
    out = np.zeros((n, FEATURES))
    best = np.zeros(len(row))
    for k in range(len(BEGINNINGS)):
        odds = lexicon.look_up(k, hashes[k])
        out[:, k] = _sum(row, (odds > 0).astype(float), n) * per_word
        np.maximum(best, odds, out=best)
    hit = best > 0
    out[:, 5] = _sum(row, hit.astype(float), n)
    out[:, 6] = out[:, 5] * per_word
    out[:, 7] = _sum(row, best, n) * per_word
    out[:, 8] = np.minimum(_sum(row, best, n), 60)
    # words of the second person within three words of a hit, in the same text
    you = np.isin(hashes[0], second)
    near = np.zeros(len(row), dtype=bool)
    for d in (-3, -2, -1, 1, 2, 3):
        if len(row) > abs(d):
            a, b = (slice(d, None), slice(None, -d)) if d > 0 else (slice(None, d), slice(-d, None))
            near[a] |= you[b] & (row[a] == row[b])
    out[:, 9] = _sum(row, (hit & near).astype(float), n) * per_word
    out[:, 10] = _sum(row, you.astype(float), n) * per_word
    for col, kind in ((11, _UPPER), (12, _MARK), (13, _SIGN), (14, _POINT), (15, _DIGIT)):
        at = np.flatnonzero(kind[buf])
        out[:, col] = _sum(row_of(at), None, n) * per_byte
    same = np.flatnonzero((buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _LETTER[buf[2:]]) if len(buf) > 2 else np.zeros(0, np.int64)
    out[:, 16] = _sum(row_of(same), None, n) * per_byte
    if len(starts):
        digits = np.bincount(np.searchsorted(starts, np.flatnonzero(_DIGIT[buf]), side="right") - 1, minlength=len(starts))
        mixed = (digits > 0) & (digits < ends - starts)
        out[:, 17] = _sum(row, mixed.astype(float), n) * per_word
        joined = np.flatnonzero((starts[1:] - ends[:-1] == 1) & _SIGN[buf[ends[:-1]]] & (row[1:] == row[:-1])) if len(starts) > 1 else np.zeros(0, np.int64)
        out[:, 18] = _sum(row[joined], None, n) * per_word
    out[:, 19] = np.log1p(n_words)
    return out


# --- learning --------------------------------------------------------------------------


def _chunks(texts: list[bytes]):
    yield from text_chunks(pa.array(texts, pa.large_binary()))


def mine(texts: list[bytes], toxic: np.ndarray) -> Lexicon:
    """Words and beginnings with document log odds of 2 or more for toxic texts."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in BEGINNINGS]
    for lo, _, buf, off in _chunks(texts):
        _, _, first, hashes = scan(buf, off)
        row = np.repeat(np.arange(lo, lo + len(off) - 1), np.diff(first))
        for k, h in enumerate(hashes):
            order = np.lexsort((row, h))
            h, r = h[order], row[order]
            keep = h != 0
            keep[1:] &= (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            found[k].append((h[keep], r[keep]))
    bad, good = toxic.sum() + 1.0, (~toxic).sum() + 1.0
    least = max(4, 0.004 * bad)
    lexicon = Lexicon()
    for k, parts in enumerate(found):
        if not parts:
            continue
        h, r = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, back = np.unique(h, return_inverse=True)
        in_bad, in_good = np.bincount(back, toxic[r], len(keys)), np.bincount(back, ~toxic[r], len(keys))
        odds = np.log((in_bad + 0.1) / bad) - np.log((in_good + 0.1) / good)
        good_keys = np.flatnonzero((in_bad >= least) & (odds >= 2))
        good_keys = np.sort(good_keys[np.argsort(-odds[good_keys] * np.sqrt(in_bad[good_keys]), kind="stable")[:LEXICON]])
        lexicon.keys[k], lexicon.odds[k] = keys[good_keys], odds[good_keys]
    return lexicon


@dataclass
class Trees:
    """Boosted regression trees of fixed depth as flat arrays (trees x nodes)."""

    base: float
    split_on: np.ndarray
    split_at: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, depth = np.full(len(x), self.base), np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for on, at, leaf in zip(self.split_on, self.split_at, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, on[node]] > at[node])
            out += leaf[node - len(on)]
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 2.0) -> Trees:
    """Newton boosting on the logistic loss, with splits at quantiles."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)  # code <= b: x <= edges[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, inner = np.full(n, base), 2**depth - 1
    on, at, leaves = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            lo = 2**level - 1
            local, k = node - lo, 2**level
            best = np.full(k, 1e-6)
            for j in range(m):
                if not len(edges[j]):
                    continue
                nb = len(edges[j]) + 1
                cell = local * nb + code[:, j]
                sg, sh = np.bincount(cell, g, k * nb).reshape(k, nb), np.bincount(cell, h, k * nb).reshape(k, nb)
                lg, lh = np.cumsum(sg, 1)[:, :-1], np.cumsum(sh, 1)[:, :-1]
                tg, th = sg.sum(1, keepdims=True), sh.sum(1, keepdims=True)
                gain = lg**2 / (lh + penalty) + (tg - lg) ** 2 / (th - lh + penalty) - tg**2 / (th + penalty)
                gain[(lh < 0.5) | (th - lh < 0.5)] = 0
                b = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(k), b] > best):
                    best[i], on[t, lo + i], at[t, lo + i] = gain[i, b[i]], j, edges[j][b[i]]
            node = 2 * node + 1 + (x[np.arange(n), on[t, node]] > at[t, node])
        last = node - inner
        leaves[t] = rate * np.bincount(last, g, inner + 1) / (np.bincount(last, h, inner + 1) + penalty)
        raw += leaves[t][last]
    return Trees(base, on, at, leaves)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw value, share) of a rising curve."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # value sum, weight, raw sum
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    second: np.ndarray
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(off) - 1, self.share)
        raw = self.trees.raw(features(buf, off, self.lexicon, self.second))
        # what the isotonic steps leave level is still ranked, by a sliver of the raw value
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def _second() -> np.ndarray:
    out = []
    for w in SECOND_PERSON:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(scan(b, np.array([0, len(b)]))[3][0][0])
    return np.array(out, np.uint64)


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Learn from texts, dealt into FOLDS by their order.

    A fold's features come from a lexicon mined without it, and the curve from trees
    grown without the fold they score; the model returned uses all rows for both.
    """
    y, second, part = np.asarray(toxic, bool), _second(), np.arange(len(texts)) % FOLDS
    share = float(y.mean()) if len(y) else 0.0
    rest = [np.flatnonzero(part != k) for k in range(FOLDS)]
    if not len(y) or any(y[r].all() or not y[r].any() for r in rest):
        return Model(Lexicon(), second, None, None, share)

    def chosen(rows: np.ndarray) -> list[bytes]:
        return [texts[i] for i in rows]

    def seen(rows: np.ndarray, lexicon: Lexicon) -> np.ndarray:
        return np.concatenate([features(x, o, lexicon, second) for _, _, x, o in _chunks(chosen(rows))] or [np.zeros((0, FEATURES))])

    x, raw = np.zeros((len(y), FEATURES)), np.zeros(len(y))
    for k in range(FOLDS):
        x[part == k] = seen(np.flatnonzero(part == k), mine(chosen(rest[k]), y[rest[k]]))
    for k in range(FOLDS):
        raw[part == k] = boost(x[rest[k]], y[rest[k]].astype(float)).raw(x[part == k])
    return Model(mine(texts, y), second, boost(x, y.astype(float)), isotonic(raw, y.astype(float)), share)


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows and TRAIN_BYTES of text that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("o"), "doc_id")
    got = _bounded(got, rows).orderBy("o", "doc_id", "text").select("toxic", "text").toArrow()
    texts, toxic = got["text"].cast(pa.large_binary()).to_pylist(), np.array(got["toxic"].to_pylist(), dtype=np.int64) == 1
    del got
    model = fit(texts, toxic)
    del texts
    trim()
    return model


def _bounded(got: DataFrame, rows: int) -> DataFrame:
    """Rows of got (toxic, text, o, doc_id) until rows or TRAIN_BYTES are used up; no single row ends the draw for rows behind it."""
    from pyspark.sql import Window as W

    order = ["o", "doc_id", "text"]
    got = got.withColumn("b", F.octet_length("text").cast("long")).where(F.col("b") <= TRAIN_BYTES)
    got = got.withColumn("long", F.when(F.col("b") > TRAIN_TEXT, F.col("b")).otherwise(0))
    kind = W.partitionBy(F.col("long") > 0, F.col("toxic") == 1)
    # how far a row is into those of its label: toxic and clean ones are used up alike
    got = got.withColumn("part", F.row_number().over(kind.orderBy(*order)) / F.count(F.lit(1)).over(kind))
    so_far = W.partitionBy(F.lit(1)).orderBy("long", "part", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return got.withColumn("n", F.count(F.lit(1)).over(so_far)).withColumn("b", F.sum("b").over(so_far)).where((F.col("n") <= rows) & (F.col("b") <= TRAIN_BYTES))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """Columns ``keep`` of docs (doc_id by default) with the calibrated score, called ``name``."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    if name in keep:
        raise ValueError(f"the score needs a name of its own, not {name!r}")
    frame = docs.select(*keep, *([] if "text" in keep else ["text"]))
    out = frame.select(*keep).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            s = [model.score(buf, off) for _, _, buf, off in text_chunks(b.column(b.schema.get_field_index("text")))]
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(s) if s else np.zeros(0))], [*keep, name])
        trim()

    return frame.mapInArrow(run, out)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
