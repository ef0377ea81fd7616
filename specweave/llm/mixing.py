"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w``: u comes from a digest of
(seed, doc_id), w is its quality weight, so small keys favour good documents and
reruns agree. A source's target is met by whole epochs first; the rest of it, a
fraction of one epoch, goes to the documents of smallest key, found by a prefix
sum of sizes in key order.

The prefix sum never sorts a source in one task: rows are dealt out by sampled quantiles
of (source, key, doc_id), so a bin holds about as many rows as any other whatever the
weights are; bin totals are summed up, and only rows of one bin and source meet in a task.
Rows that agree in all of that are told apart by a number written beside them, so even a
doc_id that fills a third of the table is spread over bins.

Defined cases: a null text has size 0 and takes part with nothing taken; a null
source is a source of its own, the last; with no words at all every target is 0;
ties of keys go by doc_id, then by size, and what still ties is alike; rows that repeat a
doc_id are separate documents, with equal keys where their quality is equal; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
JUNK = r"[#%*$@&0-9]+"
#: Weights of the sources, in order of code points, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MAX_EPOCHS = 3
#: Rows that one bin should hold, and the number of bins beyond which bins grow instead: their totals meet in one task.
BIN_ROWS, BINS = 4096, 8192
SEED = "mix"


def quality(text: Column, size: Column) -> Column:
    """Weight in [0.05, 1]: one less five times the junk runs a word."""
    junk = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(JUNK))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * junk / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, seed: str) -> Column:
    """A value in (0, 1) from the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size), one row a source, by filling to caps.

    Resharing the excess by weight until no source is above its cap ends where
    target = min(cap, level * weight). Sources fill up in order of cap / weight: with
    those before one in that order filled, what is left gives a level for the others; it
    rises as long as the next source cannot hold it and falls from then on, so its
    greatest value is the one sought. The windows see one row a source.
    """
    by_point = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_point) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("w", w).withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everything = W.partitionBy(F.lit(1))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def dealt(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key, nth and bin of every row: bins of near equal numbers of rows, in the order of source, key, doc_id."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), "text").select(
        "doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / quality(F.col("text"), F.col("size"))).alias("key"), F.monotonically_increasing_id().alias("nth")
    )
    base = cut(base)  # fixes nth: what follows may be computed again
    bins = max(1, min(BINS, base.count() // BIN_ROWS))
    return cut(base.repartitionByRange(bins, "source", "key", "doc_id", "size", "nth").withColumn("bin", F.spark_partition_id().cast("long")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken of every row of docs."""
    base = dealt(docs, seed)
    per_bin = base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("before_bin", F.coalesce(F.sum("bin_size").over(run), F.lit(0))).drop("bin_size")
    both = per_bin.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "b.bin", "b.before_bin", "g.source_size", "g.target")
    rows = base.alias("r").join(both.alias("x"), F.col("r.source").eqNullSafe(F.col("x.source")) & (F.col("r.bin") == F.col("x.bin")))
    rows = rows.select("r.*", "x.before_bin", "x.source_size", "x.target")
    in_bin = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("reach", F.col("before_bin") + F.sum("size").over(in_bin))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0))
    rows = rows.withColumn("whole", whole.cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    # a document straddling the budget goes in if most of it lies inside
    more = (F.col("reach") - F.col("size") / 2 <= rest).cast("long")
    epochs = F.least(F.lit(max_epochs).cast("long"), F.col("whole") + more)
    return rows.withColumn("epochs", epochs).select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#%*$@&0-9]+')) AS junk
  FROM documents),
k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
            / greatest(0.05::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * junk / greatest(size, 1)) AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
m AS (SELECT *, max(level) OVER () AS top FROM l),
g AS (SELECT source, source_size, least(cap, coalesce(top, 0) * w) AS target FROM m),
r AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS reach,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size + 1e-9::DOUBLE) AS BIGINT) ELSE 0 END AS whole
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, whole + CASE WHEN reach - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
