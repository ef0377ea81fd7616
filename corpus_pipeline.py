"""From documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents; ``run`` and the driver write
what a stage returns as Parquet and read it again for the next. All stages but the last
keep the columns of ``documents``, whatever others there are: names of their own are chosen
beside those of the input.

Defined cases, for all stages: an empty table gives an empty table of the same columns; a
null or empty text is kept by all stages but mixing, which takes nothing of it (it has no
words); rows without doc_id stay unless their text is toxic or contaminated; repeated rows
are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import decontamination, mixing, near_dedup, sharding, toxicity
from specweave.llm.common import drop, store, table

SHARDS = 24


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs has not, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below the threshold; labels are learned from documents as a whole.

    Without labels of both kinds every score is their share, so all documents stay or (all labels being toxic) all go.
    """
    model, score = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), _free("toxicity", docs)
    return toxicity.score(docs, model, docs.columns, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id; of rows that share a doc_id all stay or none, and rows without one stay."""
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item's text; rows go by doc_id and text, so one without doc_id goes and a clean one that shares an id stays."""
    key = F.concat_ws(":", F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string"))  # a null doc_id leaves the digest alone
    name = _free("found", docs)
    found = decontamination.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(store(found, "contaminated"), key == F.col(name), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or in up to MAX_EPOCHS rows. Rows that share a doc_id are taken as often as the luckiest of them."""
    of, times = _free("taken_id", docs), _free("times", docs)
    taken = mixing.mix(docs.select("doc_id", "source", "text")).groupBy(F.col("doc_id").alias(of)).agg(F.max("epochs").cast("int").alias(times)).where(F.col(times) > 0)
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(of)))
    return rows.withColumn(of, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard(docs.select("doc_id", "text"), SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model and greedy tiling have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)  # its rows are all judged and written anew
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
