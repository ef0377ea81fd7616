"""Token counts that follow edits.

A document is cut into pre-tokens as the tokenizer's pattern does; a byte-pair encoder
turns each of them into tokens on its own. ``TokenTree`` keeps lengths and counts of
pre-tokens in leaves of about ``LEAF`` and sums of both over a binary segment tree. An
edit is found by descending the sums; pre-tokens that end ``CONTEXT`` characters or more
before it are left alone, splitting starts again behind them and stops as soon as it
meets an old boundary behind the edit; only the pre-tokens between are encoded, and the
sums above the leaves touched are updated.

Edits of one document apply one after the other; a place counts characters of the text
as edited so far. Places and lengths beyond the text are cut to it.

Defined cases: null and empty texts have no token, and edits can fill them; a null
insertion inserts nothing, null places and lengths are 0; documents without edits keep
their count; repeated rows are separate documents; further columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
#: Characters behind a pre-token that its end may depend on: its pattern looks that far ahead.
CONTEXT = 3
#: Pre-tokens whose counts a worker remembers.
MEMORY = 200_000

_encoders: dict[str, Encoder] = {}


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Splits texts and counts the tokens of pre-tokens; counts are remembered."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    @staticmethod
    def of(path: str | None) -> Encoder:
        path = vocabulary_path(path)
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in parts]
        except KeyError:
            pass
        if len(known) > MEMORY:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in parts]


class TokenTree:
    """Pre-tokens of one document with their token counts, under sums of both."""

    def __init__(self, text: str, encoder: Encoder) -> None:
        self.text, self.encoder, self.encoded = text, encoder, 0
        parts = encoder.pattern.findall(text)
        sizes, counts = list(map(len, parts)), encoder.counts(parts)
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(parts), LEAF)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        """Sums of all nodes; node k has children 2k and 2k + 1, leaves start at self.width."""
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens, self.parts = ([0] * (2 * self.width) for _ in range(3))
        for i, (sizes, counts) in enumerate(self.leaves):
            k = self.width + i
            self.chars[k], self.tokens[k], self.parts[k] = sum(sizes), sum(counts), len(sizes)
        for k in range(self.width - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        for s in (self.chars, self.tokens, self.parts):
            s[k] = s[2 * k] + s[2 * k + 1]

    def _refresh(self, leaf: int) -> None:
        sizes, counts = self.leaves[leaf]
        k = self.width + leaf
        self.chars[k], self.tokens[k], self.parts[k] = sum(sizes), sum(counts), len(sizes)
        while k := k >> 1:
            self._add(k)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_parts(self) -> int:
        return self.parts[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and the place where it begins."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place >= start + self.chars[k] and self.parts[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, at: int, removed: int, inserted: str) -> None:
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        if not removed and not inserted:
            return
        text = self.text[:at] + inserted + self.text[at + removed :]
        shift = len(inserted) - removed
        # the first pre-token that the edit may change, from CONTEXT before it
        leaf, begin = self._leaf_at(max(0, at - CONTEXT))
        sizes = self.leaves[leaf][0]
        i, start = 0, begin
        while i < len(sizes) and start + sizes[i] + CONTEXT <= at:
            start += sizes[i]
            i += 1
        # old boundaries behind the edit, taken from further leaves as they are needed
        last, ends, reach = leaf, [], start
        for s in sizes[i:]:
            reach += s
            ends.append(reach)
        parts, here = [], start
        met = None
        for m in self.encoder.pattern.finditer(text, start):
            parts.append(m.group())
            here = m.end()
            old = here - shift
            if here < at + len(inserted):
                continue
            while reach < old and last + 1 < len(self.leaves):
                last += 1
                for s in self.leaves[last][0]:
                    reach += s
                    ends.append(reach)
            j = bisect_left(ends, old)
            if j < len(ends) and ends[j] == old:
                met = j
                break
        counts = self.encoder.counts(parts)
        self.encoded += len(parts)
        old_sizes = [s for k in range(leaf, last + 1) for s in self.leaves[k][0]]
        old_counts = [c for k in range(leaf, last + 1) for c in self.leaves[k][1]]
        if met is None:
            last, tail = len(self.leaves) - 1, ([], [])
        else:
            tail = (old_sizes[i + met + 1 :], old_counts[i + met + 1 :])
        new_sizes = old_sizes[:i] + list(map(len, parts)) + tail[0]
        new_counts = old_counts[:i] + counts + tail[1]
        self.text = text
        self._replace(leaf, last + 1, new_sizes, new_counts)

    def _replace(self, low: int, high: int, sizes: list[int], counts: list[int]) -> None:
        n = high - low
        if n and len(sizes) <= 2 * LEAF * n and (len(sizes) >= n or n == len(self.leaves) == 1):
            # the leaves touched share what there is now
            step = -(-len(sizes) // n) or 1
            for k in range(n):
                self.leaves[low + k] = (sizes[k * step : (k + 1) * step], counts[k * step : (k + 1) * step])
                self._refresh(low + k)
            return
        self.leaves[low:high] = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)]
        self.leaves = self.leaves or [([], [])]
        self._grow()


EDITS = "array<struct<at:long,removed:long,inserted:string>>"


def count_tokens(docs: DataFrame, edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_parts, n_tokens of each text, and n_edits, n_tokens_after, n_encoded of its edits.

    docs: doc_id, text and a column of EDITS. n_encoded: pre-tokens that the edits had encoded.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "n_parts", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"]

    def run(batches):
        encoder = Encoder.of(vocabulary)
        for b in batches:
            rows = []
            for text, todo in zip(b.column(1), b.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", encoder)
                before = len(tree.text), tree.n_parts, tree.n_tokens
                todo = todo.as_py() or []
                for e in todo:
                    tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((*before, len(todo), tree.n_tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.array([r[i] for r in rows], np.int64)) for i in range(6))], names)

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in names[1:])])
    return docs.select("doc_id", "text", F.col(edits).cast(EDITS)).mapInArrow(run, schema)


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with a column edits from rows (doc_id, seq, at, removed, inserted); one document's edits meet, ordered by seq."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("e"))
    each = each.select(F.col("doc_id").alias("e_id"), F.transform("e", lambda x: F.struct(x["at"].alias("at"), x["removed"].alias("removed"), x["inserted"].alias("inserted"))).alias("edits"))
    return docs.join(each, F.col("doc_id") == F.col("e_id"), "left").drop("e_id")


def revision(doc_id: Column, text: Column) -> Column:
    """The edits of op7, by the document alone: a phrase goes in, seven characters go, five are replaced."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    place = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1)
    one = lambda at, removed, inserted: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(one(place(1), 0, " as amended, see note 12: "), one(place(2), 7, ""), one(place(3), 5, "they'll"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs.withColumn("edits", revision(F.col("doc_id"), F.col("text"))))
