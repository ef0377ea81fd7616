"""Tables stored in the order of a key: places without a sort, lookups that read few files.

Rows are dealt out by sampled ranges of the key and sorted in each, so files follow each other
in its order. Beside them lies one row a file with the least and the greatest key. A lookup of
few keys opens only files whose range holds one of them, and there only the row groups that
Parquet's statistics leave; the place of a row in the whole order is its file's first place and
its row number in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a file, and bytes of a row group.
FILE_ROWS, GROUP_BYTES = 1 << 20, 1 << 20
#: Keys up to which a lookup names them to the scan; more are joined.
NAMED = 1000


def write(df: DataFrame, path: str, keys: list[str], file_rows: int = FILE_ROWS) -> None:
    """df in the order of keys (nulls first), over whatever lies at path."""
    files = max(1, -(-df.count() // file_rows))
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    key = F.struct(*keys)
    ranges = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")  # a row a file


class Ordered:
    """What write() stored below a folder, by the same keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def placed(self) -> DataFrame:
        """Rows with place, from 0: nothing is sorted or shuffled."""
        first = F.coalesce(F.sum("n").over(W.orderBy("low", "high", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        files = self.ranges().select("file", first.alias("first"))  # a row a file
        rows = self.rows().select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
        return rows.join(files, "file").withColumn("place", F.col("first") + F.col("nth")).drop("file", "first", "nth")

    def lookup(self, wanted: DataFrame, named: int = NAMED) -> DataFrame:
        """Rows whose first key is among those of wanted (a column of its name); a null key finds nothing."""
        key = self.keys[0]
        keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
        values = [r[0] for r in keys.limit(named + 1).collect()]
        if len(values) > named:
            return self.rows().join(keys, key, "left_semi")
        inside = F.exists(F.array(*map(F.lit, values)), lambda x: (F.col(f"low.{key}").isNull() | (F.col(f"low.{key}") <= x)) & (x <= F.col(f"high.{key}"))) if values else F.lit(False)
        files = [r["file"] for r in self.ranges().where(inside).collect()]  # files that hold one of the keys' ranges
        if not files:
            return self.rows().limit(0)
        return self.spark.read.schema(self.rows().schema).parquet(*files).where(F.col(key).isin(*values))
