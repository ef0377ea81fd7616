"""Exact substring dedup with a distributed suffix array.

A byte goes if some ``LENGTH``-byte string over it also starts in a document of smaller
doc_id. Suffixes matter to LENGTH bytes only, and only where a string may repeat, so the
suffix array is built in parts, one for each bucket:

1. Anchors. Of the K-byte strings inside a LENGTH-byte string the one of least hash is
   its anchor, so equal strings have equal anchors. A task sends each anchor hash once
   for every few MB of text to the bucket of the hash; buckets report hashes met twice.
2. Parts. Around each anchor so reported lies one stretch of text with all strings that
   chose it. Stretches go to the bucket of their anchor, equal ones of a task's run once,
   for its least document; the others of them are removals already.
3. Sorting. A bucket orders the suffixes at all string starts by deep-shallow sorting:
   multikey quicksort to a depth of ``SHALLOW`` (parts are quicksorted by one 8-byte
   character, and what is equal in it by the next), then blind tries for the groups with a
   longer common prefix: a node's members branch by the length that they share with its
   head and the byte after it, and bytes that a branch has in common are not read again.
   Branches below the head's, the head's own leaf and branches above it follow each other
   in the order of the suffixes. Leaves hold equal strings; all but those of the least
   document go.
4. Ranges are merged document by document and cut out of the text.

Exact copies of a whole text are handled before, by its digest. No group of copies
meets in one task: what a task sends of any string is one entry for several MB of input.

Defined cases: null and empty texts have 0 bytes and lose nothing; texts below LENGTH
bytes lose nothing; rows that share a doc_id do not repeat each other; a row with a null
doc_id loses nothing and causes no removal; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_in_parts, mix, powers, prepare, store, table, text_chunks, trim

LENGTH = 50
#: Bytes of an anchor: longer ones repeat less by chance, shorter ones are fewer.
K = 20
#: Bytes to which the multikey sort goes; blind tries take over there.
SHALLOW = 16
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 4 << 20, 256
#: Anchors that a task gathers before it sends them off, and bytes of stretches.
RUN, RUN_BYTES = 1 << 19, 3 << 20
#: Bytes of one text that are looked at in one go; pieces overlap.
PIECE = 1 << 19
#: Copies of one text that are joined with the first of them in one part.
HOT_ROWS = 4096

_U = np.uint64
_I = np.int64


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (row, first string start, number of strings, anchor hash) of rows of bytes."""
    none = np.zeros(0, _I)
    if len(buf) < length:
        return none, none, none, none.astype(_U)
    p, q = powers(len(buf) + 1)
    x = buf.astype(_U)
    x += _U(1)
    x *= p[: len(buf)]
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum(x, out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= q[: len(h)]
    h = mix(h)
    # the least (hash, place) of each window of length - k + 1 places, by doubling
    least, have, want = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U), 1, length - k + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & _U(0xFFFFFFFF)).astype(_I)
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    n_strings = np.maximum(np.diff(off) - length + 1, 0)
    starts = np.arange(n_strings.sum()) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings) + np.repeat(off[:-1], n_strings)
    if not len(starts):
        return none, none, none, none.astype(_U)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return row[head], starts[head], np.diff(np.append(head, len(at))), h[at[head]]


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, where each row of it begins in its text); long texts come in overlapping pieces."""
    for lo, _, buf, off in text_chunks(batch.column(column)):
        if len(off) == 2 and len(buf) > PIECE:
            for i in range(0, len(buf) - LENGTH + 1, PIECE):
                part = buf[i : i + PIECE + LENGTH - 1]
                yield lo, part, np.array([0, len(part)]), np.array([i])
        else:
            yield lo, buf, off, np.zeros(len(off) - 1, _I)


def _send(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns split by bucket."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edge = np.flatnonzero(np.diff(sorted_)) + 1
    for lo, hi in zip(np.concatenate(([0], edge)), np.append(edge, len(order)), strict=True):
        if hi > lo:
            yield int(sorted_[lo]), [c[order[lo:hi]] for c in columns]


def _codes(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and 32 bits more of it: a bucket holds so few anchors that they tell these apart.

    A clash would only bring a stretch to the sort that repeats nothing.
    """
    b = _U(buckets)
    return (h % b).astype(_I), ((h // b) & _U(0xFFFFFFFF)).astype(np.uint32)


def _joined(bucket: np.ndarray | int, code: np.ndarray, buckets: int) -> np.ndarray:
    return code.astype(_U) * _U(buckets) + np.asarray(bucket, _U)


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """x as a least value and offsets of as few bytes as they need."""
    low = int(x.min())
    x = (x.view(_U) - _U(low & 0xFFFFFFFFFFFFFFFF)).astype(_U)
    top = int(x.max())
    return low, x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else _U)


def _wide(low: int, raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: _U}[len(raw) // n])
    return (x.astype(_U) + _U(low & 0xFFFFFFFFFFFFFFFF)).view(_I)


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, h) of anchor hashes, shortened by _codes(), that two rows hold."""

    def gather(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            h, d = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[fresh], d[fresh]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            many = np.zeros(len(h), bool)
            many[:-1] |= ~head[1:]
            many |= ~head
            # what this run shares by itself needs no partner: it goes to any bucket, marked so
            bucket, code = _codes(h, buckets)
            out = [(b, True, x) for b, x in _send((mix(d[many].view(_U)) % _U(buckets)).astype(_I), [_joined(bucket[many], code[many], buckets), d[many]])]
            out += [(b, False, x) for b, x in _send(bucket[head], [code[head], d[head]])]
            low, ids = zip(*(_narrow(o[2][1]) for o in out), strict=True) if out else ((), ())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out]), pa.array([o[2][0].tobytes() for o in out], pa.binary()), pa.array(low, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["bucket", "known", "h", "low", "d"])

        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, buf, off, _ in _pieces(batch, 1):
                row, _, _, h = anchors(buf, off)
                held.append((h, ids[lo + row]))
                n += len(h)
                if n >= RUN:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()
        trim()

    def meet(t: pa.Table) -> pa.Table:
        oh, od, x, y, bucket = [], [], [], [], 0
        for bucket, known, h, low, d in zip(*(t.column(c).to_pylist() for c in ("bucket", "known", "h", "low", "d")), strict=True):  # noqa: B007
            h = np.frombuffer(h, _U if known else np.uint32)
            (oh if known else x).append(h)
            (od if known else y).append(_wide(low, d, len(h)))
        if x:
            x, y = np.concatenate(x), np.concatenate(y)
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            same = np.zeros(len(x), bool)
            same[1:] = x[1:] == x[:-1]
            same[:-1] |= same[1:].copy()
            oh.append(_joined(bucket, x[same], buckets))
            od.append(y[same])
        return pa.table({"doc_id": np.concatenate(od) if od else np.zeros(0, _I), "h": (np.concatenate(oh) if oh else np.zeros(0, _U)).view(_I)})

    sent = docs.select("doc_id", "text").mapInArrow(gather, "bucket int, known boolean, h binary, low long, d binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, h long")


# --- sorting a bucket --------------------------------------------------------------------


def _characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; data ends in 8 spare bytes."""
    x = data.astype(_U)
    x = (x[:-1] << _U(8)) | x[1:]
    x = (x[:-2] << _U(16)) | x[2:]
    return (x[:-4] << _U(32)) | x[4:]


def _multikey(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their first depth bytes, and for each, in that order, whether it begins a group that shares them."""
    order = np.argsort(words[at])
    w = words[at[order]]
    new = np.ones(len(at), bool)
    new[1:] = w[1:] != w[:-1]
    for k in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        part = np.flatnonzero(tied)  # only what is equal so far goes on to the next character
        if not len(part):
            break
        some, group = order[part], np.cumsum(new)[part]
        w = words[at[some] + k]
        by = np.lexsort((w, group))
        order[part] = some[by]
        w, group = w[by], group[by]
        new[part[1:]] |= (w[1:] != w[:-1]) | (group[1:] != group[:-1])
    return order, new


def _blind_tries(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in the order, and leaf number, of each suffix at[i]; one leaf holds those whose length bytes are equal.

    group: sorted numbers of the groups, whose members share depth bytes. All tries grow
    together, a level in each turn. A node's head is its first member; the others fall
    into children by the length shared with the head and the byte that follows, or into
    the head's leaf when nothing differs.
    """
    place, leaf, n_leaves = np.empty(len(at), _I), np.empty(len(at), _I), 0
    alive, known = np.arange(len(at)), np.full(len(at), depth, _I)
    base = np.arange(len(at))  # of the first of a group: its place in the order
    while len(alive):
        first = np.ones(len(alive), bool)
        first[1:] = group[1:] != group[:-1]
        lead = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        head = alive[lead][number]
        shared, up, branch = np.full(len(alive), length, _I), np.zeros(len(alive), bool), np.zeros(len(alive), _I)
        for k in reversed(range(depth, length, 8)):
            read = np.flatnonzero(known < k + 8)  # the others share these bytes already
            a, b = words[at[alive[read]] + k], words[at[head[read]] + k]
            if k + 8 > length:
                spare = _U(8 * (k + 8 - length))
                a, b = a >> spare << spare, b >> spare << spare
            diff = a ^ b
            other = np.flatnonzero(diff)
            if len(other):
                d = diff[other]
                lead_byte = 7 - (np.frexp(d.astype(np.float64))[1] - 1) // 8
                # rounding may lift a number to the next power of two
                lead_byte += (lead_byte < 7) & ((d >> (_U(56) - _U(8) * lead_byte.astype(_U))) == 0)
                shared[read[other]] = k + lead_byte
                up[read[other]] = a[other] > b[other]
                branch[read[other]] = ((a[other] >> (_U(56) - _U(8) * lead_byte.astype(_U))) & _U(255)).astype(_I)
        done = shared >= length
        # below the head the earlier difference comes first, above it the later one
        rank = np.where(done, length, np.where(up, 2 * length - shared, shared)) * 256 + branch
        key = number * ((2 * length + 1) * 256) + rank
        order = np.argsort(key, kind="stable")
        number, done, key = number[order], done[order], key[order]
        alive, known = alive[order], shared[order] + 1
        where = base[lead][number] + np.arange(len(order)) - lead[number]
        place[alive[done]], leaf[alive[done]] = where[done], n_leaves + number[done]
        n_leaves += len(lead)
        rest = np.flatnonzero(~done)
        alive, known, group, base = alive[rest], known[rest], key[rest], where[rest]
    return place, leaf


def repeats(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the suffix at[i] shares length bytes with one of a smaller doc."""
    words = _characters(np.concatenate((data, np.zeros(length + 8, np.uint8))))
    order, new = _multikey(words, at, SHALLOW)
    tied = ~new
    tied[:-1] |= ~new[1:]
    some = order[tied]
    out = np.zeros(len(at), bool)
    if len(some):
        place, leaf = _blind_tries(words, at[some], np.cumsum(new)[tied], SHALLOW, length)
        by = np.empty(len(some), _I)
        by[place] = np.arange(len(some))  # the suffix array of what is tied
        l, d = leaf[by], doc[some][by]
        first = np.ones(len(l), bool)
        first[1:] = l[1:] != l[:-1]
        head = np.flatnonzero(first)
        out[some[by]] = d > np.minimum.reduceat(d, head)[np.cumsum(first) - 1]
    return out


def _suffixes(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _runs(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of flags with one owner."""
    begin = flag.copy()
    begin[1:] &= ~(flag[:-1] & (owner[1:] == owner[:-1]))
    end = flag.copy()
    end[:-1] &= ~(flag[1:] & (owner[1:] == owner[:-1]))
    return np.flatnonzero(begin), np.flatnonzero(end)


def _digests(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of buf."""
    p, q = powers(len(buf) + 1)
    out = []
    for salt in (1, 0x51):
        sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(mix(buf.astype(_U) + _U(salt)) * p[: len(buf)], out=sums[1:])
        out.append(mix((sums[end] - sums[begin]) * q[begin]))
    return out[0], out[1]


def _squeeze(x: np.ndarray) -> bytes:
    """zstd bytes behind their length: stretches overlap and repeat words."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueeze(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[4:], int.from_bytes(b[:4], "little"), "zstd", asbytes=True), kind)


_STRETCH = ["docs", "marks", "d", "start", "n", "data"]


def repeated_ranges(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, mark, begin, end) of removed bytes. docs: doc_id, text, mark, shared (anchor hashes)."""

    def gather(batches):
        held: list[tuple] = []

        def flush():
            sizes = [len(x[5]) for x in held]
            shift = np.cumsum([0, *sizes[:-1]])
            doc, mark, start, n, place = (np.concatenate([x[i] + (s if i == 4 else 0) for x, s in zip(held, shift, strict=True)]) for i in range(5))
            data, h, *two = (np.concatenate([x[i] for x in held]) for i in range(5, 9))
            held.clear()
            # equal stretches: the least document's goes on, the others' strings all repeat it
            order = np.lexsort((doc, n, two[1], two[0]))
            head = np.ones(len(order), bool)
            head[1:] = (two[0][order][1:] != two[0][order][:-1]) | (two[1][order][1:] != two[1][order][:-1]) | (n[order][1:] != n[order][:-1])
            least = doc[order[np.flatnonzero(head)]][np.cumsum(head) - 1]
            gone = order[doc[order] > least]
            if len(gone):
                # neighbours in a document join up before they are sent
                gone = gone[np.lexsort((start[gone], mark[gone], doc[gone]))]
                d, m, begin, end = doc[gone], mark[gone], start[gone], start[gone] + n[gone] + LENGTH - 1
                new = np.ones(len(gone), bool)
                new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (begin[1:] > end[:-1])
                first = np.flatnonzero(new)
                yield _ranges(d[first], m[first], begin[first], np.maximum.reduceat(end, first))
            keep = np.sort(order[doc[order] == least])  # all places in the least document: what follows decides on them
            for b, (s,) in _send((h[keep] % _U(buckets)).astype(_I), [keep]):
                names, back = np.unique(np.stack([doc[s], mark[s]]), axis=1, return_inverse=True)
                size = n[s] + LENGTH - 1
                parts = [names[0], names[1], back.reshape(-1).astype(np.int32), start[s].astype(_I), n[s].astype(np.int32), data[_suffixes(place[s], size)]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([None], pa.int64()) for _ in range(4)), *(pa.array([_squeeze(x)], pa.binary()) for x in parts)], ["bucket", "doc_id", "mark", "begin", "end", *_STRETCH])

        def _ranges(doc, mark, begin, end):
            nothing = pa.nulls(len(doc), pa.binary())
            spread = pa.array((mix(doc.astype(_U)) % _U(buckets)).astype(np.int32))
            return pa.RecordBatch.from_arrays([spread, *(pa.array(np.asarray(x, _I)) for x in (doc, mark, begin, end)), *[nothing] * 6], ["bucket", "doc_id", "mark", "begin", "end", *_STRETCH])

        total = 0
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            wanted = batch.column(3).to_pylist()
            for lo, buf, off, begins in _pieces(batch, 1):
                row, start, n, h = anchors(buf, off)
                if not len(h):
                    continue
                code = _joined(*_codes(h, buckets), buckets)
                edge, good = np.searchsorted(row, np.arange(len(off))), np.zeros(len(h), bool)
                for i in range(len(off) - 1):
                    if edge[i + 1] > edge[i]:
                        good[edge[i] : edge[i + 1]] = np.isin(code[edge[i] : edge[i + 1]], np.frombuffer(wanted[lo + i], _U))
                s = np.flatnonzero(good)
                if not len(s):
                    continue
                size = n[s] + LENGTH - 1
                held.append((ids[lo + row[s]], marks[lo + row[s]], start[s] - off[row[s]] + begins[row[s]], n[s], np.cumsum(size) - size, buf[_suffixes(start[s], size)], h[s], *_digests(buf, start[s], start[s] + size)))
                total += int(size.sum())
                if total >= RUN_BYTES:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()
        trim()

    def sort(t: pa.Table) -> pa.Table:
        direct = t.filter(t.column("doc_id").is_valid()).select(["doc_id", "mark", "begin", "end"])
        parts = t.filter(t.column("docs").is_valid())
        if not parts.num_rows:
            return direct
        kinds = [_I, _I, np.int32, _I, np.int32, np.uint8]
        got = [[_unsqueeze(x, kind) for x in parts.column(c).to_pylist()] for c, kind in zip(_STRETCH, kinds, strict=True)]
        doc, mark = (np.concatenate([a[d] for a, d in zip(got[i], got[2], strict=True)]) for i in (0, 1))
        start, n, data = (np.concatenate(got[i]) for i in (3, 4, 5))
        n = n.astype(_I)
        size = n + LENGTH - 1
        at, owner = _suffixes(np.cumsum(size) - size, n), np.repeat(np.arange(len(n)), n)
        flag = repeats(data, at, doc[owner])
        a, b = _runs(flag, owner)
        o = owner[a]
        base = start - (np.cumsum(n) - n)
        del at, owner, flag
        trim()
        found = pa.table({"doc_id": doc[o], "mark": mark[o], "begin": base[o] + a, "end": base[o] + b + LENGTH})
        return pa.concat_tables([direct.cast(found.schema), found])

    sent = docs.mapInArrow(gather, "bucket int, doc_id long, mark long, begin long, end long, docs binary, marks binary, d binary, start binary, n binary, data binary")
    return sent.groupBy("bucket").applyInArrow(sort, "doc_id long, mark long, begin long, end long")


def _merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return begin[head], reach[np.append(head[1:], len(begin)) - 1]


def dedup_substrings(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    digest = [F.xxhash64("text").alias("mark"), F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").cast("long").alias("size")]
    about = cut(docs.where("doc_id is not null").select("doc_id", *digest))
    buckets = max(BUCKETS, -(-(about.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    first = about.where(F.col("size") >= LENGTH).groupBy("mark", "digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    copies = cut(join_in_parts(about, cut(first), ["mark", "digest"], ["doc_id"], HOT_ROWS).where("doc_id > first").select("doc_id", "mark", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end")))

    known = docs.where("doc_id is not null")
    # lists of one document's anchors and ranges, bounded by its length; collected after the shuffle
    wanted = shared_anchors(known, buckets).repartition("doc_id").groupBy("doc_id").agg(F.collect_list("h").alias("hs"))
    # a copy's strings all occur in the first of its group, which alone speaks for it
    wanted = wanted.join(copies.groupBy("doc_id").agg(F.collect_set("mark").alias("skip")), "doc_id", "left")
    wanted = store(wanted.select("doc_id", _packed("hs"), "skip"), "anchors")
    again = known.join(wanted, "doc_id").withColumn("mark", F.xxhash64("text")).where(F.col("skip").isNull() | ~F.array_contains("skip", F.col("mark")))
    found = repeated_ranges(again.select("doc_id", "text", "mark", "shared"), buckets)
    ranges = found.union(copies).repartition("doc_id", "mark").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    ranges = store(ranges, "ranges")
    return _cut_out(docs.withColumn("mark", F.xxhash64("text")).join(ranges, ["doc_id", "mark"], "left"), keep_text)


def _packed(name: str):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def pack(x):
        return x.map(lambda v: np.unique(np.asarray(v, dtype=_I).view(_U)).tobytes())

    return pack(name).alias("shared")


def _cut_out(rows: DataFrame, keep_text: bool) -> DataFrame:
    rows = rows.select("doc_id", "text", F.col("ranges.begin").alias("begin"), F.col("ranges.end").alias("end"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches):
        for b in batches:
            size, removed, spans, sha, left = [], [], [], [], []
            begins, ends = b.column(2), b.column(3)
            for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                raw = t.as_py()
                size.append(len(raw))
                if begins[i].is_valid:
                    p, q = _merge(np.asarray(begins[i].as_py(), _I), np.asarray(ends[i].as_py(), _I))
                    raw = b"".join(raw[x:y] for x, y in zip([0, *q.tolist()], [*p.tolist(), len(raw)], strict=True))
                    spans.append(len(p))
                else:
                    spans.append(0)
                removed.append(size[-1] - len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                left.append(raw)
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(left, pa.binary())] * keep_text], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Strings are compared as hexadecimal, two digits a byte.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS m FROM w) WHERE m < doc_id),
o AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM r),
p AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM o),
q AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM p GROUP BY doc_id, k),
e AS (SELECT d.doc_id, d.x, q.k, q.a, q.b, coalesce(lag(q.b) OVER (PARTITION BY d.doc_id ORDER BY q.k), 0) AS was,
             lead(q.a) OVER (PARTITION BY d.doc_id ORDER BY q.k) IS NULL AS fin
      FROM d LEFT JOIN q ON d.doc_id = q.doc_id)
SELECT doc_id, CAST(any_value(len(x)) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
       sha256(unhex(string_agg(CASE WHEN a IS NULL THEN x ELSE substr(x, 2 * was + 1, 2 * (a - was)) || CASE WHEN fin THEN substr(x, 2 * b + 1) ELSE '' END END, '' ORDER BY k))) AS kept_sha256
FROM e GROUP BY doc_id
"""
