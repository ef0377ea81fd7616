"""Operators that choose, merge and count rows. Keys are spread by hash; groups are pre-aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each group that comes last in an order; a partial limit runs before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[o for o in order])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def by_edition(year: str = "is_year", number: str = "kys_id") -> list[Column]:
    """Newest year first, unknown years last, then the later id."""
    return [F.coalesce(F.col(year), F.lit(-1)).desc(), F.col(number).desc()]


def current_first(status: str = "status", year: str = "is_year", number: str = "kys_id") -> list[Column]:
    return [(F.lower(F.coalesce(F.col(status), F.lit(""))) == "current").desc(), *by_edition(year, number)]


def unknown_year_first(year: str = "is_year", number: str = "kys_id") -> list[Column]:
    """The order in which a missing year beats every known one."""
    return [F.col(year).desc_nulls_first(), F.col(number).desc()]


def history(df: DataFrame, newest: DataFrame, key: str = "kys_id") -> DataFrame:
    return df.join(newest.select(key), key, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def lookup(df: DataFrame, side: DataFrame, key: str, columns: Sequence[str], default: str = "") -> DataFrame:
    """Left join that fills what is missing; Spark broadcasts the side if it is small enough."""
    return df.join(side.select(key, *columns), key, "left").fillna(default, list(columns))


def joined_text(df: DataFrame, key: str, value: str, order: str, separator: str = " ") -> DataFrame:
    """Values of a key in one string, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x[value].cast("string")), separator).alias(value))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"))  # one row
    return n.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def merge_metadata(base: DataFrame, found: DataFrame, key: str = "kys_id", year: str = "reaffirmed_year", edition: str = "is_year") -> DataFrame:
    """Years raised to the greater of both, unless the one found precedes the edition; change says what happened."""
    f = found.select(key, F.col(year).alias("__found"))
    usable = F.when(F.col("__found") >= F.coalesce(F.col(edition), F.lit(0)), F.col("__found"))
    out = base.join(f, key, "left").withColumn("__new", F.greatest(F.col(year), usable))
    change = (
        F.when(F.col("__found").isNull(), "not found")
        .when(usable.isNull(), "dropped")
        .when(F.col(year).isNull(), "filled")
        .when(F.col("__new") > F.col(year), "raised")
        .otherwise("kept")
    )
    return out.withColumn("change", change).withColumn(year, F.col("__new")).drop("__found", "__new")


def fingerprint(df: DataFrame, order: str, text: str, digits: int = 16) -> DataFrame:
    """One hash of all texts in order: hashes of rows are hashed by ranges of ids, and those hashes again.

    What meets in one place is 64 hexadecimal digits for each of at most 4096 ranges.
    """
    row = F.sha2(F.concat(F.col(order).cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit(""))), 256)
    cells = df.groupBy(F.pmod(F.col(order), F.lit(4096)).alias("cell")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("h"))
    return cells.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "h"))), lambda x: x["h"]), ""), 256), 1, digits).alias("fingerprint"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key that is not empty: the last in order, as a table loaded row by row would leave it."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.where(F.coalesce(key, F.lit("")) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def required(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df, whose columns must be there with these types and without nulls: types are checked now, values when rows are read."""
    for name, kind in fields.items():
        if name not in df.columns:
            raise ValueError(f"the column {name} is missing")
        if df.schema[name].dataType.simpleString() != kind:
            raise TypeError(f"{name} is {df.schema[name].dataType.simpleString()}, not {kind}")
    cols = {n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"{n} is null")).cast(k)).otherwise(F.col(n)) for n, k in fields.items()}
    return df.withColumns(cols)


def unchanged_shape(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, if a merge kept the columns in their order and the number of rows; else an error."""
    if before.columns != after.columns:
        raise ValueError(f"columns changed: {before.columns} became {after.columns}")
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"{n} rows became {m}")
    return after


def smallest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows of least value: a top-k, cut in every task."""
    return df.orderBy(column).limit(n)


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a hash of key and seed, the same in every run and for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
