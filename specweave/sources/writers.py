"""Sinks. Every write is a new version or an overwrite of the whole; nothing is patched in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with LF line ends; with ``columns`` exactly those, others ignored and missing ones empty."""
    if columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    df.write.mode("overwrite").csv(path, header=True, lineSep="\n", escape='"', emptyValue="")


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, UTF-8, null fields left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def merged_json(records: DataFrame, changes: DataFrame, key: str, path: str) -> dict[str, int]:
    """Records with fields replaced from changes, written as a new version; how many changed and were not found."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("__hit"))
    both = records.join(c, key, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"new_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"new_{f}")))
    merged = both.select(*[F.coalesce(f"new_{x}", x).alias(x) if x in fields else F.col(x) for x in records.columns])
    json_lines(merged, path)
    n = both.agg(F.count_if(differs).alias("changed")).first()
    return {"changed": n["changed"], "missing": changes.join(records.select(key), key, "left_anti").count()}


def term_list(df: DataFrame, path: str, header: str) -> None:
    """Sorted terms below a comment line. A reviewed list of terms is small, so it is one file."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, f"# {header}")], "o int, value string")
    body = df.select(F.lit(1).alias("o"), F.lower("term").alias("value")).distinct()
    head.union(body).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Target with a batch's rows in place of those of equal keys; writing it twice changes nothing.

    Of several rows of one key in a batch the last in ``order`` wins; without an order they are
    compared column by column, so that it is always the same one.
    """
    by = [F.col(c).desc_nulls_last() for c in order or [c for c in batch.columns if c not in keys] or keys]
    newest = batch.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(newest)


def vectors(df: DataFrame, path: str, key: str = "kys_id", vector: str = "embedding") -> None:
    """Vectors as floats, of length 1, ready for inner products; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(vector, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))
    df.select(F.col(key).cast("long").alias("kys_id"), unit.alias("vector")).write.mode("overwrite").parquet(path)


def thresholds(fitted: DataFrame, path: str) -> None:
    """The tiers' lower bounds as a table that readers.thresholds() finds: no source is rewritten."""
    fitted.select("high_min", "related_min").coalesce(1).write.mode("overwrite").parquet(path)


def index_metadata(df: DataFrame, path: str, **about: object) -> None:
    """One row about an index: a fingerprint table and what it was built with."""
    df.select("*", *[F.lit(v).alias(k) for k, v in about.items()]).write.mode("overwrite").parquet(path)


def is_stale(found: DataFrame, stored: DataFrame, columns: list[str]) -> bool:
    """Whether stored metadata differs from what the data gives now."""
    return found.select(*columns).first() != stored.select(*columns).first()
