"""Engine tables over the driver's star schema.

parts stand for editions of standards, order lines for references between them, and the
twin in SQL (``CTES``) states the same mapping for DuckDB.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import shared_folder
from ..operators import lexical

#: Tables of long texts: a small file of them may be a single row group, which one task would read and work on alone.
TEXTS = ("documents", "pages", "conversations")
#: Bytes for each core below which such a table is dealt out anew.
SMALL = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str, parsed: bool = False) -> DataFrame:
    """A table. parsed: every row goes through Python, so that a small file of any table is worth dealing out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if (parsed or name in TEXTS) and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL:
        df = df.repartition(cores)
    return df


def stored_index(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame, tokens: Column, table: str = "documents") -> lexical.Index:
    """The stored index of a table's texts, made once for a state of its files and read by every later query; it goes with the checkpoint folder."""
    at = hashlib.sha256(f"{sf_dir}:{table}:{name}".encode()).hexdigest()[:16]
    return lexical.of_source(spark, f"{shared_folder(spark)}/index-{name}-{at}", docs, tokens, lexical.fingerprint(spark, f"{sf_dir}/{table}.parquet"))


def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions: several to a base id, some without a year, some withdrawn, some parts of a number."""
    k = F.col("p_partkey")
    base = F.concat(F.lit("IS "), (100 + k % 97).cast("string"), F.when(k % 4 == 1, F.concat(F.lit(" (Part "), (1 + k % 3).cast("string"), F.lit(")"))).otherwise(""))
    return read(spark, sf_dir, "part").select(
        k.alias("kys_id"),
        base.alias("is_base_id"),
        F.concat(base, F.lit(":"), (1960 + F.col("p_size")).cast("string")).alias("is_number"),
        F.when(k % 7 != 0, 1960 + F.col("p_size")).cast("int").alias("is_year"),
        F.when(k % 3 == 0, "withdrawn").otherwise("current").alias("status"),
        (k % 5 != 0).alias("is_canonical"),
        F.col("p_name").alias("title"),
        F.when(k % 2 == 0, "Product Specification").when(k % 9 == 0, "Methods of Test").alias("aspect"),
        F.col("p_brand").alias("dept_code"),
        F.when(k % 11 != 0, F.col("p_retailprice") > 950).alias("mandatory_cert"),
        F.when((k % 3 == 0) & (k > 3), F.floor(k / 3).cast("long")).alias("replaced_by_id"),
        F.when(k % 4 != 0, 1970 + F.col("p_size") + (k % 9) - 4).cast("int").alias("reaffirmed_year"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References (line's supplier to part) and replacements, with repeats and dangling ends."""
    refs = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1999 + 1).alias("src"), F.lit("REFERENCES").alias("rel"), F.col("l_partkey").alias("dst"))
    more = standards(spark, sf_dir).where("replaced_by_id is not null").select(F.col("kys_id").alias("src"), F.lit("REPLACED_BY").alias("rel"), F.col("replaced_by_id").alias("dst"))
    return refs.union(more)


CTES = """
standards AS (
  SELECT p_partkey AS kys_id, b AS is_base_id, b || ':' || CAST(1960 + p_size AS VARCHAR) AS is_number,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(1960 + p_size AS INTEGER) END AS is_year,
         CASE WHEN p_partkey % 3 = 0 THEN 'withdrawn' ELSE 'current' END AS status,
         p_partkey % 5 <> 0 AS is_canonical, p_name AS title,
         CASE WHEN p_partkey % 2 = 0 THEN 'Product Specification' WHEN p_partkey % 9 = 0 THEN 'Methods of Test' END AS aspect,
         p_brand AS dept_code, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice > 950 END AS mandatory_cert,
         CASE WHEN p_partkey % 3 = 0 AND p_partkey > 3 THEN CAST(floor(p_partkey / 3) AS BIGINT) END AS replaced_by_id,
         CASE WHEN p_partkey % 4 <> 0 THEN CAST(1970 + p_size + (p_partkey % 9) - 4 AS INTEGER) END AS reaffirmed_year
  FROM (SELECT *, 'IS ' || CAST(100 + p_partkey % 97 AS VARCHAR) || CASE WHEN p_partkey % 4 = 1 THEN ' (Part ' || CAST(1 + p_partkey % 3 AS VARCHAR) || ')' ELSE '' END AS b FROM part)),
raw_edges AS (
  SELECT l_orderkey % 1999 + 1 AS src, 'REFERENCES' AS rel, l_partkey AS dst FROM lineitem
  UNION ALL SELECT kys_id, 'REPLACED_BY', replaced_by_id FROM standards WHERE replaced_by_id IS NOT NULL),
edges AS (
  SELECT DISTINCT src, rel, dst FROM raw_edges WHERE src IN (SELECT kys_id FROM standards) AND dst IN (SELECT kys_id FROM standards)),
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_base_id ORDER BY coalesce(is_year, -1) DESC, kys_id DESC) AS rn
                 FROM standards WHERE status = 'current' AND is_canonical) WHERE rn = 1)
"""


def sql(body: str, *more: str) -> str:
    """A statement over the tables above; more are further CTEs."""
    return "WITH RECURSIVE " + ",\n".join([CTES.strip(), *(m.strip() for m in more)]) + "\n" + body.strip()
