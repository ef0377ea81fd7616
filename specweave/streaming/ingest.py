"""Fetched pages as they come in: a status for each attempt, and an index that grows by a segment a batch.

The log is append-only: a batch writes a folder of its own, over what an attempt of the same
batch may have left, so it is never patched and a batch done twice is there once. A resumed
fetch asks the log which keys still lack a final status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.lexical import Index
from ..sources.readers import not_yet_done

FETCHED = "kys_id long, search_code int, preview_url string, preview_code int, html string, error string"
LOG = "kys_id long, status string"
#: Bytes below which a page holds nothing, and statuses that no further attempt changes.
EMPTY_BYTES = 1500
FINAL = ("ok", "no_preview_link", "preview_empty")


def status() -> Column:
    """What became of a fetch in two steps: search for a preview, then get it."""
    code = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    bad = lambda c: ~F.coalesce(F.col(c) == 200, F.lit(False))
    return (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), F.col("error")))
        .when(bad("search_code"), F.concat(F.lit("search_http_"), code("search_code")))
        .when(F.coalesce("preview_url", F.lit("")) == "", "no_preview_link")
        .when(bad("preview_code"), F.concat(F.lit("preview_http_"), code("preview_code")))
        .when(F.octet_length(F.coalesce("html", F.lit(""))) < EMPTY_BYTES, "preview_empty")
        .otherwise("ok")
    )


class StatusLog:
    """Statuses of attempts below a folder, by batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, statuses: DataFrame, batch: int) -> None:
        statuses.select("kys_id", "status").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        """kys_id, status and batch of all attempts."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            return self.spark.createDataFrame([], f"{LOG}, batch int")
        return self.spark.read.schema(f"{LOG}, batch int").parquet(self.path)

    def latest(self) -> DataFrame:
        """kys_id and the status of its last attempt; of several in a batch a final one counts, then the first by name."""
        rank = F.struct("batch", F.col("status").isin(*FINAL).cast("int"), F.col("status"))
        return self.read().groupBy("kys_id").agg(F.max_by("status", rank).alias("status"))

    def open(self, wanted: DataFrame) -> DataFrame:
        """Keys of wanted (kys_id) that a resumed fetch still has to get."""
        return not_yet_done(wanted, self.latest(), "kys_id", FINAL)


def ingest(log: StatusLog, index: Index, tokens: Callable[[str], Column], stream: str = "pages"):
    """A foreachBatch over FETCHED rows: statuses go to the log, pages that are there to a segment of the index (key kys_id)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("status", status())
        index.add(rows.where("status = 'ok'").select("kys_id", text.html_to_text("html").alias("text")), tokens("text"), f"{stream}:{batch_id}")
        log.append(rows, batch_id)  # last: what the log calls done is searchable

    return run
