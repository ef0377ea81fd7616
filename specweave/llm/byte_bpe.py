"""Byte-level BPE by merge replay over words of the corpus.

Texts are cut into words by the tokenizer's pattern; the ids of a word do not depend on
its surroundings. ``replay`` turns many words into ids at once: all their bytes lie in one
row of tokens, linked with their neighbours inside the word, and an inverted index leads
from the rank of a token pair to the positions where the pair stands. The merges that
occur are applied in rank order, each at all its positions, from left to right; only the
pairs with the two neighbours of a merged place are looked up anew and enter the index.

Words are replayed once for the corpus: ``vocabulary`` counts all words of all texts,
replays those that make up one part in ``SHARE`` or more of all occurrences, in tasks of
hashed words, and hands them to every task. There are at most ``SHARE`` such words, of at
most ``WIDE`` bytes each, so what is sent has a bound whatever the corpus is. All other
words are replayed in the task that meets them, together with the others that are new in
the same run of texts, of ``RUN`` characters or so. Words are the same either way, so nothing depends on the
bound.

A word that is a token as a whole is that token. Where a merge makes a pair of no higher rank than its
own, order within the word decides, so such a word is encoded on its own by the least rank,
from the left.

Defined cases: null text is empty and has no token; repeated rows give equal values;
further columns are ignored; ids decode to exactly the bytes of the text. A task holds one
run of texts with their words and one text with its ids: memory goes with the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, store, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A word is shared between tasks if it is one in so many of all occurrences; and its bytes at most.
SHARE, WIDE = 1 << 17, 64
#: Characters of texts whose new words are replayed together.
RUN = 1 << 22
#: Different words that a task counts before it hands them on, and that a worker remembers beside the shared ones.
COUNTED, HELD = 200_000, 1_000_000

_NONE = -1
_codecs: dict[str, Codec] = {}


class Codec:
    """Ranks and pattern of a byte-level BPE, with the ids of words seen so far."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self._start()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}
        self.shared: dict[str, bytes] = {}

    @staticmethod
    def of(path: str | None) -> Codec:
        if not path:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        if path not in _codecs:
            _codecs[path] = Codec(path)
        return _codecs[path]

    def _start(self) -> None:
        """Tokens of single bytes, those that two bytes make, and all pairs of tokens that make one, by their keys."""
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([self.ranks.get(bytes(x), _NONE) for x in itertools.product(range(256), repeat=2)], np.int64)
        pairs = {(self.ranks[w[:i]] << 32 | self.ranks[w[i:]]): made for w, made in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.makes = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """The tokens that pairs make, or _NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.makes[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian unsigned 32-bit integers, by replaying merges over all of them."""
        known = [self.ranks.get(w, _NONE) for w in words]
        rest = [w if k == _NONE else b"" for w, k in zip(words, known, strict=True)]
        data = np.frombuffer(b"".join(rest), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in rest], dtype=np.int64)
        n = len(data)
        token = self.single[data]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = ends[np.diff(ends, prepend=0) > 0] - 1
        right[last] = _NONE
        left[last[:-1] + 1] = _NONE
        made = np.full(n, _NONE, np.int64)  # what a place makes with its right neighbour
        made[:-1] = self.first[data[:-1] << 8 | data[1:]]
        made[last] = _NONE
        # the index: places by the rank of their pair, those of the beginning in one sorted row, later ones in lists
        places = np.argsort(made, kind="stable")[np.count_nonzero(made == _NONE) :]
        ranks, begins = np.unique(made[places], return_index=True)
        start = {r: places[i:j] for r, i, j in zip(ranks.tolist(), begins.tolist(), [*begins.tolist(), len(places)][1:], strict=True)}
        later: defaultdict[int, list[int]] = defaultdict(list)
        queue = list(start)  # ranks that occur, sorted and so a heap
        odd: list[np.ndarray] = []
        while queue:
            rank = heappop(queue)
            at = start.pop(rank, None)
            if rank in later:
                more = np.array(later.pop(rank), np.int64)
                at = np.unique(more if at is None else np.concatenate((at, more)))
            at = at[made[at] == rank]  # others were merged away, or make another pair by now
            if not len(at):
                continue
            next_ = right[at]
            touching = next_[:-1] == at[1:]
            if touching.any():
                # of places in a row that share a token every other one is merged, from the left
                head = np.flatnonzero(np.concatenate(([True], ~touching)))
                step = np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))
                at, next_ = at[step % 2 == 0], next_[step % 2 == 0]
            after, before = right[next_], left[at]
            has, had = after >= 0, before >= 0
            a, b = at[has], before[had]
            between = self.pairs(np.full(len(a), rank), token[after[has]])  # before the right neighbour is merged itself
            token[at], token[next_], made[next_], right[at], made[at] = rank, _NONE, _NONE, after, _NONE
            left[after[has]] = a
            made[a] = new = self.pairs(np.full(len(a), rank), token[after[has]])
            made[b] = new_b = self.pairs(token[b], rank)
            bad = np.concatenate((a[((new >= 0) & (new <= rank)) | ((between >= 0) & (between <= rank))], b[(new_b >= 0) & (new_b <= rank)]))
            if len(bad):
                odd.append(bad)
            for where, what in ((a, new), (b, new_b)):
                fits = what >= 0
                for m, p in zip(what[fits].tolist(), where[fits].tolist(), strict=True):
                    if m not in later and m not in start:
                        heappush(queue, m)
                    later[m].append(p)
        held = np.concatenate(([0], np.cumsum(token >= 0)))[np.concatenate(([0], ends))].tolist()
        ids = token[token >= 0].astype("<u4").tobytes()
        out = [ids[4 * i : 4 * j] if k == _NONE else k.to_bytes(4, "little") for i, j, k in zip(held[:-1], held[1:], known, strict=True)]
        for i in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist() if odd else ():
            out[i] = self.by_least(words[i])
        return out

    def by_least(self, word: bytes) -> bytes:
        """Ids of one word, merging the leftmost pair of least rank again and again."""
        pair = lambda a, b: self.ranks.get(self.bytes[a] + self.bytes[b], _NONE)
        token = self.single[list(word)].tolist()
        left, right = list(range(-1, len(token) - 1)), [*range(1, len(token)), _NONE]
        queue = [(made, at) for at in range(len(token) - 1) if (made := pair(token[at], token[at + 1])) != _NONE]
        heapify(queue)
        while queue:
            rank, at = heappop(queue)
            next_ = right[at]
            if token[at] == _NONE or next_ == _NONE or pair(token[at], token[next_]) != rank:
                continue
            token[at], token[next_] = rank, _NONE
            after = right[at] = right[next_]
            if after != _NONE:
                left[after] = at
            for x in (left[at], at):
                if x != _NONE and right[x] != _NONE and (made := pair(token[x], token[right[x]])) != _NONE:
                    heappush(queue, (made, x))
        return np.array([t for t in token if t != _NONE], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Ids of these words are known afterwards."""
        new = [w for w in words if w not in self.shared and w not in self.known]
        if len(self.known) + len(new) > HELD:
            self.known.clear()
            new = [w for w in words if w not in self.shared]
        self.known.update(zip(new, self.replay([w.encode() for w in new]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; new words of all of them are replayed together."""
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*cut))
        known, shared = self.known, self.shared
        for parts in cut:
            yield b"".join([shared.get(w) or known[w] for w in parts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def word_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """word (bytes) and n, its occurrences in all texts."""

    def run(batches):
        find, held = Codec.of(vocabulary).pattern.findall, Counter()

        def flush():
            words = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for t in b.column(0):
                held.update(find(t.as_py() or ""))
                if len(held) > COUNTED:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """word, ids (bytes) of distinct words, replayed together wherever they lie."""

    def run(batches):
        codec = Codec.of(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.replay(b.column(0).to_pylist()), pa.binary())], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word binary, ids binary")


def vocabulary_of(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """word, ids of the words that are one in SHARE or more of all occurrences."""
    counts = store(word_counts(docs, vocabulary), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return replayed(counts.where((F.col("n") * SHARE >= total) & (F.octet_length("word") <= WIDE)), vocabulary)


def encode(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, with ids and decoded bytes where they are kept."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast({r["word"].decode(): bytes(r["ids"]) for r in vocabulary_of(docs, vocabulary).collect()})
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.binary(), "decoded": pa.binary()}
    names = [*digests, *keep]

    def run(batches):
        codec = Codec.of(vocabulary)
        codec.shared = shared.value

        def rows_of(held: list[pa.RecordBatch]):
            ids_of = iter(codec.encode([t or "" for b in held for t in b.column(1).to_pylist()]))
            for b in held:
                rows = []
                for ids in itertools.islice(ids_of, b.num_rows):
                    text = codec.decode(ids)
                    rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(text).hexdigest(), "ids": ids, "decoded": text})
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], kinds[n]) for n in names)], ["doc_id", *names])

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                held.append(part)
                size += part.column(1).nbytes
                if size > RUN:
                    yield from rows_of(held)
                    held, size = [], 0
        if held:
            yield from rows_of(held)

    types = {"n_tokens": "long", "ids": "binary", "decoded": "binary"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=())
