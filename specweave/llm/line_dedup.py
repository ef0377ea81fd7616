"""Line dedup by winnowing over line hashes, with DataFrame operations only.

A passage is ``MIN_RUN`` lines that follow each other; or fewer lines that hold
``LONG_WORDS`` words or ``LONG_BYTES`` bytes; or the whole of a document of fewer than
``MIN_RUN`` lines, if it holds a word. A passage is repeated if the same lines stand at an
earlier place (smaller doc_id, or higher up in the same document). Every line that some
repeated passage covers is deleted; passages are judged on the input.

1. Winnowing. Of each window of ``MIN_RUN`` line hashes the least (the last of equals) is a
   fingerprint, so two equal runs have the same fingerprints at the same offsets. A place is
   kept once, however many windows chose it, with the lines around it.
2. Join. Places whose fingerprint stands at one place only end there. The others are joined
   with the first place of their fingerprint.
3. Extension. Both ways of the fingerprint the lines are compared with those round the first
   place; each window that agrees is a repeat. Longer runs are covered window by window, for
   every window of them has its fingerprint. What does not agree with the first place may
   still agree with a later one: these windows meet by all their lines, with counts and
   minima, never pairs of places.
4. Passages of fewer lines are shorter than a window; they are fingerprints as wholes.

Common fingerprints are joined in parts: the few that hold more than ``HOT_ROWS`` places are
known before the join and dealt out by document.

Defined cases: a null or empty text has one empty line; rows that repeat a doc_id and a text
are one place (the first of them is kept by all), rows of one doc_id and different texts
stand in the order of a hash of the text; a null doc_id comes first; further columns are
ignored. Words are parted by ASCII white space.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_in_parts, store, table

MIN_RUN = 3
#: Fewer lines than MIN_RUN are a passage from so many words, or bytes (for scripts without spaces).
LONG_WORDS, LONG_BYTES = 50, 512
#: Places of one fingerprint that are joined in one part.
HOT_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(docs: DataFrame) -> list[Column]:
    """What tells rows apart: the doc_id, and a hash of the text for rows that share one."""
    return ["doc_id", F.xxhash64("text").alias("mark")]


def _choices(h: Column, p: Column, run: int) -> Column:
    """First lines of the windows of run lines in which line p is the fingerprint; null where it is not."""
    at = lambda j: F.get(h, p - 1 + j)
    found = []
    for back in range(run):
        inside = (p - back >= 1) & (p - back + run - 1 <= F.size(h))
        least = [at(0) <= at(-j) for j in range(1, back + 1)] + [at(0) < at(j) for j in range(1, run - back)]
        for x in least:
            inside = inside & x
        found.append(F.when(inside, p - back))
    return F.array(*found)


def places(docs: DataFrame, run: int) -> DataFrame:
    """doc_id, mark, fp, at, starts (of the windows that chose it) and around (run - 1 hashes to either side) of every fingerprint."""
    hashes = F.transform(_lines_of(), lambda x: F.xxhash64(x))
    d = docs.select(*_row(docs), hashes.alias("h")).where(F.size("h") >= run)
    h = F.col("h")
    one = lambda p: F.struct(
        F.get(h, p - 1).alias("fp"), p.alias("at"), _choices(h, p, run).alias("starts"), F.array(*[F.when(p + j >= 1, F.get(h, p - 1 + j)) for j in range(1 - run, run)]).alias("around")
    )
    every = F.transform(F.sequence(F.lit(1), F.size("h")), one)
    return d.select("doc_id", "mark", F.inline(F.filter(every, lambda x: F.exists(x["starts"], lambda s: s.isNotNull()))))


def _firsts(pieces: DataFrame, key: list[str], *more: str) -> DataFrame:
    """Of every key that stands at two places: the first of them (and ``more`` columns there), and n, the rows."""
    place = F.struct("doc_id", "mark", "at")
    first = pieces.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "at", *more)).alias("first"), F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
    return store(first.where(~F.col("a").eqNullSafe(F.col("b"))).drop("a", "b"), "firsts")


def _joined(pieces: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """Pieces with the first place of their key, but those that are it; hot keys are joined in parts."""
    out = join_in_parts(pieces, first, key, ["doc_id", "mark", "at"], HOT_ROWS)
    return out.where(~F.struct("doc_id", "mark", "at").eqNullSafe(F.struct("first.doc_id", "first.mark", "first.at")))


def _later_runs(docs: DataFrame, run: int) -> DataFrame:
    """doc_id, mark and at of every run of lines that stands at an earlier place too."""
    found = store(places(docs, run), "places")
    met = _joined(found, _firsts(found, ["fp"], "around"), ["fp"])
    # a window that starts back lines above the fingerprint is run of the 2 * run - 1 hashes around it
    window = lambda c, back: F.slice(c, run - back, run)
    each = [F.struct(F.get("starts", F.lit(back)).alias("at"), window("around", back).alias("w"), (window("around", back) == window("first.around", back)).alias("same")) for back in range(run)]
    windows = store(met.select("doc_id", "mark", F.inline(F.filter(F.array(*each), lambda x: x["at"].isNotNull()))), "windows")
    rest = windows.where("not coalesce(same, false)").select("doc_id", "mark", "at", F.xxhash64("w").alias("k1"), F.hash("w").alias("k2"))
    key = ["k1", "k2"]
    return windows.where("same").select("doc_id", "mark", "at").union(_joined(rest, _firsts(rest, key), key).select("doc_id", "mark", "at"))


def short_passages(docs: DataFrame, run: int, words: int, size: int) -> DataFrame:
    """doc_id, mark, at, lines (their number) and key of what is long in fewer than run lines, and of whole documents of fewer (kind 'd')."""
    # a line's words, and bytes, beside its hashes: lines are long or short by these alone
    line = lambda x: F.struct(F.regexp_count(x, F.lit(WORD)).alias("w"), F.octet_length(x).alias("b"), F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"))
    d = docs.select(*_row(docs), F.transform(_lines_of(), line).alias("ls"))
    total = lambda i, n, c: functools.reduce(lambda x, y: x + y, [F.get(F.col("ls"), i - 1 + j)[c] for j in range(n)])
    piece = lambda kind, at, a: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), F.size(a).alias("lines"), F.xxhash64(a["h1"]).alias("k1"), F.hash(a["h2"]).alias("k2"))
    found = []
    for n in range(1, run):
        starts = F.when(F.size("ls") >= n, F.sequence(F.lit(1), F.size("ls") - (n - 1))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: (total(i, n, "w") >= words) | (total(i, n, "b") >= size))  # noqa: B023
        found.append(F.transform(starts, lambda i: piece("l", i, F.slice("ls", i, n))))  # noqa: B023
    whole = F.when((F.size("ls") < run) & F.exists("ls", lambda x: x["w"] > 0), F.array(piece("d", F.lit(1), F.col("ls"))))
    found.append(F.coalesce(whole, F.slice(F.array(piece("d", F.lit(1), F.col("ls"))), 2, 1)))
    return d.select("doc_id", "mark", F.inline(F.concat(*found))).select("doc_id", "mark", "at", "lines", "kind", "k1", "k2")


def repeated(docs: DataFrame, run: int = MIN_RUN, words: int = LONG_WORDS, size: int = LONG_BYTES) -> DataFrame:
    """doc_id, mark and removed, the sorted line numbers (from 1) that repeated passages cover."""
    key = ["kind", "lines", "k1", "k2"]
    short = store(short_passages(docs, run, words, size), "passages")
    later = _later_runs(docs, run).select("doc_id", "mark", "at", F.lit(run).alias("n"))
    later = later.union(_joined(short, _firsts(short, key), key).select("doc_id", "mark", "at", F.col("lines").cast("int")))
    starts = later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "n")).alias("starts"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    return starts.select("doc_id", "mark", lines.alias("removed"))


def dedup_lines(docs: DataFrame, run: int = MIN_RUN, words: int = LONG_WORDS, size: int = LONG_BYTES) -> DataFrame:
    """docs's doc_id with kept text, n_lines, n_removed (lines) and n_runs (of removed lines)."""
    d = docs.select(*_row(docs), _lines_of().alias("lines"))
    r = repeated(docs, run, words, size).withColumnsRenamed({"doc_id": "r_id", "mark": "r_mark"})
    d = d.join(r, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), gone)
    kept = F.when(F.col("removed").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i - 1)), "\n"))
    return d.select(
        "doc_id",
        kept.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(F.array_except(gone, F.transform(gone, lambda i: i + 1))).cast("long").alias("n_runs"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, n, unnest(range(1, len(ls) - n + 2)) AS a FROM d, (SELECT unnest([1, 2, 3]) AS n) WHERE len(ls) >= n),
k AS (SELECT doc_id, a, n, 'l' AS kind, ls[a:a + n - 1] AS key FROM w),
p AS (
  SELECT * FROM k
  WHERE n = 3 OR len(regexp_extract_all(array_to_string(key, ' '), '[^ 	-
]+')) >= 50 OR strlen(array_to_string(key, '')) >= 512
  UNION ALL
  SELECT doc_id, 1, len(ls), 'd', ls FROM d WHERE len(ls) < 3 AND regexp_matches(array_to_string(ls, ' '), '[^ 	-
]')),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY doc_id, a) AS rn FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS line FROM f WHERE rn > 1),
l AS (SELECT doc_id, unnest(ls) AS txt, unnest(range(1, len(ls) + 1)) AS line FROM d),
j AS (SELECT l.doc_id, l.txt, l.line, g.line IS NOT NULL AS gone,
             coalesce(lag(g.line IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.line), false) AS was
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT was) AS n_runs,
       CAST(strlen(coalesce(string_agg(txt, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS BIGINT) AS kept_bytes,
       sha256(coalesce(string_agg(txt, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
