"""Shared helpers: lineage cuts, Arrow batching and byte-level word scanning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python: texts may be long, so batches stay short.
ARROW_ROWS = 256
#: Bytes of text that the numpy scanners look at in one go.
CHUNK_BYTES = 1 << 18


def prepare(spark: SparkSession) -> None:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts. One of our own only where none is set and one machine runs all tasks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="specweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a compressed table below the checkpoint folder and read it again.

    Its lineage ends there and its shuffle files go when the write ends. The table goes by
    ``drop``, or else with the driver.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


cut = store


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``store`` wrote and that no later plan reads."""
    for t in tables:
        files, at = _files(t.sparkSession, t.stored_at)
        files.delete(at, True)


#: Keys that may be hot at once however few tasks there are, so tables of them may be broadcast.
HOT_KEYS = 4096


def hot(counts: DataFrame, total: int, least: int) -> DataFrame:
    """The rows of counts (a row a key, n rows of total) whose key holds more than least rows, and more than a task's even share.

    A task's share is total by the session's shuffle partitions, or by HOT_KEYS if those are
    fewer. Fewer keys than these can hold more than that, so the result has a row or so for each
    task at most, of a few bytes.
    """
    tasks = max(HOT_KEYS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return counts.where(F.col("n") > max(least, total // tasks))


def join_in_parts(rows: DataFrame, keyed: DataFrame, key: list[str], by: list[str], part_rows: int) -> DataFrame:
    """rows joined with keyed, a stored table of one row a key with n, its number of rows; no key adds many more than part_rows, or a task's even share of all rows, to a part of the join.

    Rows of a hot key are dealt out by a hash of ``by``, and the key's row goes to each part.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    warm = hot(keyed, total, part_rows).select(*key, F.ceil(F.col("n") / part_rows).alias("parts"))
    dealt = rows.join(F.broadcast(warm), key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")), F.lit(0))).drop("parts")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))
    spread = keyed.drop("n").join(F.broadcast(warm), key, "left").withColumn("part", parts).drop("parts")
    return dealt.join(spread, [*key, "part"]).drop("part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give freed memory back to the system; workers live on between stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


# --- byte-level scanning -------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of longer characters.
NOT_WORD = np.ones(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_WORD[_a:_b] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_pow.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, base, dtype=_U)
            a[0] = 1
            _pow[name] = np.cumprod(a, dtype=_U)
    return _pow["p"], _pow["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets) of runs of rows; null is empty.

    A run holds about ``limit`` bytes; a longer text is a run of its own, whole.
    """
    arrays = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    base = 0
    for a in arrays:
        if not len(a):
            continue
        a = a.cast(pa.large_binary()) if not pa.types.is_large_binary(a.type) else a
        if a.null_count:
            a = a.fill_null(b"")
        off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
        data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            j = min(j, len(a))
            yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        base += len(a)


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (byte positions) and the first word of each row (n + 1).

    Words are runs of bytes outside ``gap``, by default space and 09-0D; rows never join.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~gap[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begin[first] = solid[first]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    stop[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


class Spans:
    """Hashes of stretches of one byte buffer, from prefix sums.

    A long buffer is worked on in parts around the stretches asked for, so that what is
    held beside it does not grow with its length. Hashes do not depend on places.
    """

    def __init__(self, buf: np.ndarray, whole: bool = False) -> None:
        self.buf = buf
        self.sums = None
        if whole or len(buf) <= 4 * CHUNK_BYTES:
            p, self.q = powers(len(buf) + 1)
            x = buf.astype(_U)
            x += _U(1)
            x *= p[: len(buf)]
            self.sums = np.zeros(len(buf) + 1, _U)
            np.cumsum(x, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of buf[starts[i]:ends[i]]; starts rise."""
        if self.sums is not None:
            return mix((self.sums[ends] - self.sums[starts]) * self.q[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
        out, i = np.empty(len(starts), _U), 0
        while i < len(starts):
            low = int(starts[i])
            j = int(np.searchsorted(starts, low + CHUNK_BYTES))
            part = Spans(self.buf[low : int(ends[i:j].max())], whole=True)
            out[i:j] = part.hashes(starts[i:j] - low, ends[i:j] - low)
            i = j
        return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word; A-Z count as a-z."""
    return Spans(LOWER[buf]).hashes(starts, ends)


def one_hash(word: bytes) -> int:
    """The hash that word_hashes() gives this word, lower-cased."""
    b = np.frombuffer(word, np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0]) if len(b) else 0


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, sorted and distinct within each row, and the first of each row (n + 1).

    A row of one to k - 1 words has its whole sequence as one shingle; an empty row has none.
    """
    count = np.diff(first)
    n_sh = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    edge = np.concatenate(([0], np.cumsum(n_sh)))
    row = np.repeat(np.arange(len(count)), n_sh)
    at = np.arange(edge[-1]) - edge[row] + first[row]
    val = np.zeros(edge[-1], _U)
    for j in range(k):
        inside = at + j < first[row + 1]
        w = np.where(inside, h[np.minimum(at + j, max(len(h) - 1, 0))], _U(0)) if len(h) else val
        val = mix(val * _U(0xFF51AFD7ED558CCD) + w + _U(j + 1))
    order = np.lexsort((val, row))
    val, row = val[order], row[order]
    keep = np.ones(len(val), bool)
    keep[1:] = (val[1:] != val[:-1]) | (row[1:] != row[:-1])
    val, row = val[keep], row[keep]
    return val, np.searchsorted(row, np.arange(len(count) + 1))
