"""Sharding by sampled splitters, with DataFrame operations only.

Rows are ordered by a 63-bit key: the text's CRC-32 above 31 hash bits of doc_id, so
equal texts lie side by side and yet a text that fills a third of all rows can be
split. A sample, drawn with chances in proportion to row sizes and bounded by
``SAMPLE``, gives splitters at its quantiles; ranges that hold too many rows are
subdivided by a second sample, of their rows, so that neither a text that fills part of a
range nor rows too short to be sampled make a cell large. Rows that agree in text and
doc_id are told apart by a number written beside them; samples draw by it, too, so that
rows of one doc_id, or of none, are sampled like all others. Totals of the cells are summed up,
and rows of one cell alone are sorted together, which gives every row its place in the
whole order.

Law ``bytes``: the order is cut into stretches of near equal bytes. A group of equal
texts smaller than ``KEEP`` of a shard goes into one shard whole; larger groups are
cut like other rows. Law ``rows``: cut by places, counts at most one apart.

Defined cases: a null text counts as empty (size 8, CRC 0); an empty table gives no
row; repeated rows, and rows that share a doc_id or have none, are separate rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Keys in the sample, on average; all that is ever collected.
SAMPLE = 8192
#: Ranges before subdivision, at most.
RANGES = 1024
#: Rows of a cell, and the number of cells beyond which cells grow instead: their totals meet in one task.
RANGE_ROWS, CELLS = 8192, 16384
#: Rows of the second sample for each cell that a range is cut into.
SECOND = 32
#: Share of a shard up to which a group of equal texts stays whole.
KEEP = 0.02


def _place(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below key, by two short searches."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda a: F.size(F.filter(a, lambda x: x <= key))
    heads = below(F.array(*[F.lit(r[0]) for r in runs]))
    run = F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in runs]), F.greatest(heads, F.lit(1)))
    return F.when(heads == 0, F.lit(0)).otherwise((heads - 1) * step + below(run))


def _search(bounds: Column, x: Column) -> Column:
    """Number of sorted bounds at or below x, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(CELLS.bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= x), at + step).otherwise(at))


def dealt(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int, int]:
    """doc_id, size, text_crc32, key, nth and the cell (part, sub) of every row, in the order of key, nth; the rows and bytes in all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = base.withColumns({"key": F.col("text_crc32") * (1 << 31) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "nth": F.monotonically_increasing_id()})
    base = cut(base)  # fixes nth: what follows may be computed again
    total = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n, size = total["n"], max(1, total["size"])
    range_rows = max(range_rows, n // CELLS)

    draw = F.pmod(F.xxhash64("doc_id", "nth", F.lit("splitter")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sample = sorted(r[0] for r in base.where(draw < F.col("size") * (SAMPLE / size)).select("key").collect())
    ranges = max(1, min(RANGES, n // range_rows * 4, len(sample)))
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})
    rows = base.withColumn("part", _place(F.col("key"), bounds))

    # one row for each of at most RANGES ranges, so this side may be broadcast
    fine = F.struct("key", "nth")
    seen = rows.groupBy("part").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > range_rows)
    cuts = F.ceil(F.col("held") / range_rows).cast("int")
    drawn = rows.join(F.broadcast(seen), "part").where(F.pmod(F.xxhash64("doc_id", "nth", F.lit("second")), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.lit(SECOND) * cuts / F.col("held"))
    sorted_ = F.array_sort(F.collect_list(fine))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), cuts - 1))
    # SECOND rows or so for each of at most 2 * CELLS cells are collected, by range; their quantiles are what is broadcast
    second = drawn.groupBy("part", "held").agg(sorted_.alias("s")).select("part", F.transform(steps, lambda i: F.get("s", F.floor(F.size("s") * i / cuts).cast("int"))).alias("bounds"))
    rows = rows.join(F.broadcast(second), "part", "left").withColumn("sub", F.coalesce(_search(F.col("bounds"), fine), F.lit(0)).cast("long")).drop("bounds")
    return rows, n, size


def shard(docs: DataFrame, n_shards: int = 24, law: str = "bytes", keep: float = KEEP, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    rows, n, size = dealt(docs, range_rows)
    before = W.orderBy("part", "sub").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    cells = rows.groupBy("part", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("held")).select("part", "sub", zero("bytes").alias("bytes_before"), zero("held").alias("rows_before"))
    inside = W.partitionBy("part", "sub").orderBy("key", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.join(cells, ["part", "sub"]).withColumns({
        "begin": F.col("bytes_before") + F.sum("size").over(inside) - F.col("size"),
        "place": F.col("rows_before") + F.row_number().over(inside) - 1,
    })
    if law == "rows":
        rows = rows.withColumn("shard", F.floor(F.col("place") * n_shards / F.lit(max(1, n))).cast("int"))
    else:
        groups = rows.groupBy("text_crc32").agg(F.min("begin").alias("from"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("held")).where("held > 1")
        small = F.col("bytes") <= keep * size / n_shards
        # at most n_shards / keep texts are large; their rows look for no group and are dealt out by themselves
        large = groups.where(~small).select("text_crc32", F.lit(True).alias("large"))
        rows = rows.join(F.broadcast(large), "text_crc32", "left")
        rows = rows.withColumn("own", F.when(F.col("large").isNull(), F.col("text_crc32")).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "nth"), F.lit(1 << 31))))
        rows = rows.join(groups.where(small).select(F.col("text_crc32").alias("own"), (F.col("from") + F.col("bytes") / 2).alias("middle")), "own", "left")
        middle = F.coalesce("middle", F.col("begin") + F.col("size") / 2)
        rows = rows.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(size)))).cast("int"))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "place")
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    rows = rows.join(F.broadcast(first), "shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
