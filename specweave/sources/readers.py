"""Sources. Schemas are stated, never inferred; paths may lie in any store that Spark reads."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Editions as they are delivered: everything a string, coerced by standards().
STANDARDS = T.StructType([T.StructField(n, T.StringType()) for n in (
    "kys_id is_number is_base_id is_year status is_canonical title_clean common_title aspect group sub_group sub_sub_group dept_code committee_code mandatory_cert qco_status "
    "reaffirmed_year replaced_by_id replaced_by_is"
).split()])
EVALUATION = "id string, text string, gold array<string>, domain string, note string"
#: A scanned document has fewer characters a page than this.
SCAN_CHARS = 40


class ScannedDocumentError(ValueError):
    """The document holds images of pages and no text."""


def csv_text(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV whose fields stay as they are written: no nulls are guessed, an empty field is ''."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="\0", emptyValue="", enforceSchema=False)
    df = df.fillna("", df.columns)
    return df.select(*columns) if columns else df


def standards(spark: SparkSession, path: str, schema: T.StructType = STANDARDS) -> DataFrame:
    """Editions with typed columns; what cannot be read as a number is null, "Is" becomes "IS"."""
    t = lambda c, kind: F.expr(f"try_cast(trim(`{c}`) as {kind})").alias(c)
    kinds = {"kys_id": "bigint", "replaced_by_id": "double", "is_year": "double", "reaffirmed_year": "double", "is_canonical": "boolean", "mandatory_cert": "boolean"}
    df = csv_text(spark, path, schema)
    cols = [t(c, kinds[c]) if c in kinds else F.col(c) for c in df.columns]
    df = df.select(*cols).withColumn("is_number", F.regexp_replace("is_number", r"^Is\b", "IS"))
    for c, kind in (("is_year", "int"), ("reaffirmed_year", "int"), ("replaced_by_id", "bigint")):
        df = df.withColumn(c, F.col(c).cast(kind))
    return df.withColumn("mandatory_cert", F.coalesce("mandatory_cert", F.lit(False)))


def csv_with_comments(spark: SparkSession, path: str, columns: tuple[str, ...] = ("lang", "term", "english")) -> DataFrame:
    """A glossary: "#" lines skipped, fields trimmed, incomplete rows dropped, terms lower case, longest first."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, comment="#", enforceSchema=False)
    df = df.select(*[F.trim(c).alias(c) for c in columns]).where(" and ".join(f"coalesce({c}, '') <> ''" for c in columns))
    return df.withColumn("term", F.lower("term")).orderBy(F.char_length("term").desc(), "lang", "term")


def json_lines(spark: SparkSession, path: str, schema: str = EVALUATION) -> DataFrame:
    """One record a line; blank and broken lines give no row. broken_lines() counts the latter."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.where(_is_object("value")).select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def _is_object(c: str) -> Column:
    return F.expr(f"coalesce(schema_of_variant(try_parse_json({c})) like 'OBJECT%', false)")


def broken_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) <> ''").where(~_is_object("value")).count()


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a list: trimmed, lower case, each once; "#" starts a comment line. A missing file has none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], "term string")
    t = spark.read.text(path).select(F.lower(F.trim("value")).alias("term"))
    return t.where("term <> '' and not startswith(term, '#')").distinct()


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are, trimmed, in order (n from 0); "#" starts a comment line. Addresses keep their case."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "value"))
    return t.select("n", F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def gazetteer(spark: SparkSession, *paths: str) -> DataFrame:
    """Mined and reviewed terms together."""
    out = term_list(spark, paths[0])
    for p in paths[1:]:
        out = out.union(term_list(spark, p))
    return out.distinct()


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as UTF-8; bytes that are none become the replacement character."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def pages(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Stored pages, numbered by file name."""
    df = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("page_id"), F.decode("content", "UTF-8").alias("html"))
    return df.where(F.col("page_id").isin(ids)) if ids else df


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, n_pages, text, scanned. Text needs pdfplumber on the executors; without it text is null."""

    def run(batches):
        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        for b in batches:
            rows = []
            for content in b["content"]:
                if pdfplumber is None:
                    rows.append((None, None))
                    continue
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    rows.append((len(pdf.pages), "\n".join(p.extract_text() or "" for p in pdf.pages)))
            yield pd.DataFrame({"path": b["path"], "n_pages": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, n_pages long, text string")
    return df.withColumn("scanned", F.char_length(F.trim("text")) < SCAN_CHARS * F.col("n_pages"))


def readable(documents: DataFrame) -> DataFrame:
    """The documents, or an error once a scanned one is read."""
    bad = F.raise_error(F.concat(F.lit("scanned document without text: "), F.col("path")))
    return documents.withColumn("text", F.when(F.coalesce("scanned", F.lit(False)), bad.cast("string")).otherwise(F.col("text")))


def one_document(spark: SparkSession, text: str) -> DataFrame:
    """A typed text as a document table; blank text is refused."""
    if not text.strip():
        raise ValueError("the document is empty")
    return spark.createDataFrame([("typed", text)], "path string, text string")


def wanted(editions: DataFrame, ids: list[int] | None = None, families: list[str] | None = None, departments: list[str] | None = None) -> DataFrame:
    """The editions that a fetch is asked for: by id, else families with all their parts, else departments, else all."""
    if ids:
        return editions.where(F.col("kys_id").isin(*ids))
    if families:
        base, out = F.coalesce("is_base_id", F.lit("")), F.lit(False)
        for f in families:
            out = out | (base == f) | F.startswith(base, F.lit(f + " ")) | F.startswith(base, F.lit(f + "("))
        return editions.where(out)
    return editions.where(F.col("dept_code").isin(*[d.upper() for d in departments])) if departments else editions


def pdf_cached(files: DataFrame) -> DataFrame:
    """Downloads (path, content) that are PDF by their first bytes; what a server sends in place of one is not kept."""
    return files.where(F.hex(F.substring("content", 1, 5)) == "255044462D")


def not_yet_done(wanted: DataFrame, status: DataFrame, key: str = "kys_id", final: tuple[str, ...] = ("ok", "no_preview_link", "preview_empty")) -> DataFrame:
    """What a resumed fetch still has to do: rows without a final status."""
    return wanted.join(status.where(F.col("status").isin(*final)).select(key).distinct(), key, "left_anti")


def flattened_documents(documents: DataFrame, cache: str | None = None) -> DataFrame:
    """path and text as one line of ASCII, without codes of missing glyphs. With a cache folder, documents read before are not read again."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\(cid:\d+\)", " "), r"[^\x00-\x7f]+", " "), r"\s+", " "))
    out = documents.select("path", flat.alias("text"))
    if cache is None:
        return out
    spark = documents.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.schema("path string, text string").parquet(cache)
        out.join(held.select("path"), "path", "left_anti").write.mode("append").parquet(cache)
    else:
        out.write.parquet(cache)
    return spark.read.schema("path string, text string").parquet(cache).join(documents.select("path"), "path", "left_semi")


def cache_names(urls: DataFrame, url: str = "line") -> DataFrame:
    """urls with the name that a download of each is kept under."""
    return urls.withColumn("name", F.concat(F.substring(F.md5(url), 1, 10), F.lit(".pdf")))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """kys_id, vector as they were saved."""
    return spark.read.schema("kys_id long, vector array<float>").parquet(path)


def thresholds(spark: SparkSession, path: str, high: float, related: float) -> tuple[float, float]:
    """Stored lower bounds of the tiers, or those given where none are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    row = spark.read.parquet(path).first() if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
    return (row["high_min"], row["related_min"]) if row else (high, related)
