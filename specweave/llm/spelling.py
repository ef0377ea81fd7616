"""Spelling variants: pairs of words that are one edit apart, found in an errata trie.

``trie`` turns the words into rows of one trie, a row a node that a word passes, and counts
how many words lie below every edge. The edge of most words at a node is its heavy edge
(ties: the greatest character), all others are light; a word that ends at a node counts as a light
edge, too. Two words part at one node, so at least one of them leaves it by a light edge.
``errata`` takes only these (small to large: a word lies below a light edge at most
log2(words) times) and puts each of them back beside the heavy edge with one error at the
node, where v is what was read so far, a the character that follows in the word, h the heavy
one and x the rest:

* v x, a skipped; v h x, a replaced by h; v h a x, h skipped in the other word: a terminal
  that coincides with a word of the trie gives a pair;
* v * x, a replaced by anything: the light subtrees of a node merge, and terminals that
  coincide give pairs among them.

Where x begins with a, the words part further down and the first is left out there, so each
pair comes up exactly once, at the node where its words part. This holds whatever edge is
called heavy; sizes only keep the work small.

Rows name nodes by hashes of what was read (two nodes that share a hash share a heavy edge,
which costs nothing but work) and words by numbers of a stored table. A node of many words
(the root has all of them) is dealt out over several tasks. At most one word for every
character that the alphabet has meets in a merged terminal.

Defined cases: null and empty texts have no run; a null doc_id counts as an empty string in
the hash; rows that share a doc_id are judged one by one; further columns are ignored. A
very long run is one word: its prefixes are hashed, never written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_in_parts, mix, powers, prepare, store, table

RUN = r"[A-Za-zÀ-ÿ]+"
#: Stands for any character; no run holds it.
ANY = "*"
#: One run in so many loses a character.
DAMAGE = 199
SHORTEST, FEWEST = 6, 5
#: A variant's form occurs at least so many times as often.
TIMES = 5
#: Rounds that double what form chains lead to: a chain of k steps needs counts of TIMES ** k, and those are below 2 ** 63.
ROUNDS = 5
#: Rows of one edge that meet in one task.
PART_ROWS = 20_000

_U = np.uint64
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, run: Column) -> Column:
    """A lower-cased run, without one character if the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word and n of all runs of docs (doc_id, text) that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= shortest).select("doc_id", F.translate("run", _A, _Z).alias("run"))
    found = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= shortest)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def trie(named: DataFrame) -> DataFrame:
    """(id, depth, node, edge) of every node on the way of every word of named (id, word); edge is null where the word ends."""
    prepare(named.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            size = np.array([len(t) for t in texts], np.int64)
            begin = np.cumsum(size) - size
            row = np.repeat(np.arange(len(texts)), size + 1)  # a place before each character, and one behind the last
            depth = np.arange(len(row)) - (begin + np.arange(len(texts)))[row]
            last = depth == size[row]
            p, _ = powers(int(size.max(initial=0)) + 1)
            value = np.zeros(len(row), _U)
            value[~last] = (points.astype(_U) + _U(1)) * p[depth[~last]]
            before = np.cumsum(value, dtype=_U) - value
            node = mix(before - before[(begin + np.arange(len(texts)))[row]] + mix(depth.astype(_U)))
            edge = np.zeros(len(row), np.int32)
            edge[~last] = points
            kinds = pa.array(node.view(np.int64)), pa.array(edge, mask=last)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(depth.astype(np.int32)), *kinds], ["id", "depth", "node", "edge"])

    return named.select("id", "word").mapInArrow(run, "id long, depth int, node long, edge int")


def light_edges(rows: DataFrame) -> DataFrame:
    """(node, edge, heavy, n) of every light edge of rows of trie(): n words lie below it, and the node's heavy edge is named."""
    edges = rows.groupBy("node", "edge").agg(F.count(F.lit(1)).alias("n"))
    nodes = edges.groupBy("node").agg(F.max(F.when(F.col("edge").isNotNull(), F.struct("n", "edge"))).alias("heavy"), F.collect_list(F.struct("edge", "n")).alias("edges"))
    each = nodes.where(F.col("heavy").isNotNull() & (F.size("edges") > 1)).select("node", F.col("heavy.edge").alias("heavy"), F.inline("edges"))
    return each.where(~F.col("edge").eqNullSafe(F.col("heavy")))


def errata(named: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(word, n, depth, heavy) for every light edge that a word of named (id, word, n) passes; heavy is a character."""
    rows = store(trie(named), "trie")
    light = store(light_edges(rows).select("node", F.coalesce("edge", F.lit(-1)).alias("edge"), "heavy", "n"), "light")
    places = join_in_parts(rows.select("id", "depth", "node", F.coalesce("edge", F.lit(-1)).alias("edge")), light, ["node", "edge"], ["id"], part_rows)
    return places.select("id", "depth", _char("heavy").alias("heavy")).join(named, "id").select("word", "n", "depth", "heavy")


def _char(code: str) -> Column:
    """The character of a code point, whatever plane it is of."""
    return F.decode(F.unhex(F.lpad(F.hex(F.col(code)), 8, "0")), "UTF-32")


def near_words(words: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(word, near, near_n) of all pairs of words (word, n) that are one edit apart, both ways, each once."""
    named = store(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    entries = store(errata(named, part_rows), "errata")
    v, x = F.substring("word", F.lit(1), F.col("depth")), F.substring("word", F.col("depth") + 2, F.char_length("word"))
    a = F.substring("word", F.col("depth") + 1, F.lit(1))
    skipped = F.when((a != "") & (F.substring(x, 1, 1) != a), F.concat(v, x))
    replaced = F.when(a != "", F.concat(v, "heavy", x))
    other = F.concat(v, "heavy", a, x)
    found = entries.select("word", "n", F.explode(F.array_compact(F.array(skipped, replaced, other))).alias("near"))
    found = found.join(named.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    pairs = found.select("word", "n", "near", "near_n")
    merged = entries.where(a != "").groupBy(F.concat(v, F.lit(ANY), x).alias("key")).agg(F.collect_list(F.struct("word", "n")).alias("here")).where(F.size("here") > 1)
    among = merged.select("here", F.inline("here")).select("word", "n", F.explode("here").alias("o")).where(F.col("word") < F.col("o.word"))
    pairs = pairs.union(among.select("word", "n", "o.word", "o.n"))
    both = F.array(F.struct("word", F.col("near"), F.col("near_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def variants(words: DataFrame, times: int = TIMES, part_rows: int = PART_ROWS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word (word, n)."""
    words = store(words, "words")
    near = near_words(words, part_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    out = words.join(near, "word", "left")
    good = -F.col("best.minus") >= times * F.col("n")
    out = store(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")), "forms")
    ways = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))
    for _ in range(ROUNDS):
        ways = ways.join(ways.select(F.col("word").alias("to"), F.col("to").alias("further")), "to", "left").select("word", F.coalesce("further", "to").alias("to"))
        ways = store(ways, "roots")
    return out.join(ways.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by its table, byte by byte; near words by the texts that are left when a character goes.
ORACLE_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
r AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM d WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
c AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1]))) AS crc FROM h, tab),
e AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM c),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) t(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, goal) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.goal WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.goal AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.word = f.word JOIN f l ON l.word = chain.goal WHERE l.form IS NULL
"""
