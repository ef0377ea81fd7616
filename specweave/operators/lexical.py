"""A stored lexical index: immutable segments of postings in blocks, and BM25 that skips blocks.

A segment is written once from documents and their tokens:

    docs      doc, dl (number of tokens), rng, t (tokens): one row a document
    postings  token, rng, docs, tfs, dls, n, max_tf, min_dl: one row a token and range of documents,
              sorted by token in each file, so that Parquet's statistics skip row groups
    terms     token, df

Documents of a partition are sorted by length, and ``RANGE`` of them in a row are a range. A block
of postings never leaves a range, so what a document of a range can score for a query is
bounded by the sum of its blocks' bounds, each from the greatest count and the least length.
``search`` scores the most promising ranges of every query in full, takes the score of place
``top`` as a threshold, and then reads only the blocks of ranges whose bound reaches it. An index
of few ranges is read whole. What is found equals a search of all postings either way.

A manifest names the segments of a version, the documents that later segments replaced, and
the statistics of the whole. It is written last, so a version is either there or not; a batch
writes its own segment and a manifest, and a batch done twice changes nothing. ``compact`` joins
segments of like size. Document numbers, lengths and counts are those of the whole index, so
ranks do not depend on how documents came in.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import stored
from .retrieval import EPSILON, K1, B, ranked

#: Documents of a range.
RANGE = 128
#: Ranges of a query that are scored before the threshold is known; more where that many hold fewer than the rows asked for.
FIRST = 4
#: Segments of like size (within this factor) that compaction joins, once there are so many.
TIER = 4
#: Ranges of an index up to which a search reads all: bounds cost more than they save.
FEW = 1024
#: Tokens of a query set up to which they are named in the scan's filter.
NAMED = 2000
_SLACK = 2e-6  # scores are rounded to six places


@dataclass(frozen=True)
class Manifest:
    """One version: segments as (name, documents, batches), and statistics of live documents."""

    version: int = 0
    segments: tuple[tuple[str, int, list[str]], ...] = ()
    n: int = 0
    tokens: int = 0
    mean_idf: float = 0.0
    source: str = ""
    dead: tuple[str, ...] = field(default=())

    @property
    def mean_length(self) -> float:
        return self.tokens / self.n if self.n else 1.0


class Index:
    """An index below a folder; ``key`` is the documents' column and its type."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> None:
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind

    # --- files

    def _names(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return [f.getPath().getParent().getName() for f in found or []]

    def manifest(self) -> Manifest:
        """The newest whole version."""
        versions = [int(n[1:]) for n in self._names("manifest/v*/_SUCCESS")]
        if not versions:
            return Manifest()
        row = json.loads(self.spark.read.text(f"{self.path}/manifest/v{max(versions)}").first()[0])
        return Manifest(row["version"], tuple(map(tuple, row["segments"])), row["n"], row["tokens"], row["mean_idf"], row["source"], tuple(row["dead"]))

    def _commit(self, m: Manifest) -> Manifest:
        line = json.dumps({"version": m.version, "segments": m.segments, "n": m.n, "tokens": m.tokens, "mean_idf": m.mean_idf, "source": m.source, "dead": m.dead})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v{m.version}")
        return m

    def _table(self, name: str, segments: list[str]) -> DataFrame | None:
        out = None
        for s in segments:
            one = self.spark.read.parquet(f"{self.path}/segments/{s}/{name}").withColumn("segment", F.lit(s))
            out = one if out is None else out.unionByName(one)
        return out

    def _dead(self, m: Manifest) -> DataFrame | None:
        """(segment, doc) of documents that a later segment replaced."""
        return self.spark.read.parquet(*[f"{self.path}/dead/{d}" for d in m.dead]) if m.dead else None

    def live(self, m: Manifest | None = None) -> DataFrame:
        """segment, doc, dl, rng, t of all documents that count."""
        m = m or self.manifest()
        docs = self._table("docs", [s for s, *_ in m.segments])
        if docs is None:
            return self.spark.createDataFrame([], f"doc {self.kind}, dl int, rng long, t array<string>, segment string")
        dead = self._dead(m)
        return docs if dead is None else docs.join(dead, ["segment", "doc"], "left_anti")

    # --- writing

    def _write_segment(self, docs: DataFrame) -> tuple[str, int]:
        """docs: doc, dl, t, dealt out by doc. Name and documents of a new segment; nothing refers to it yet."""
        name = f"s{uuid.uuid4().hex}"
        at = f"{self.path}/segments/{name}"
        # a row's number in its partition, which is in order of length, tells its range
        nth, low = F.monotonically_increasing_id(), (1 << 33) - 1
        rng = F.shiftright(F.col("nth"), 33) * (1 << 33) + F.floor(F.col("nth").bitwiseAND(low) / RANGE)
        docs.sortWithinPartitions("dl", "doc").withColumn("nth", nth).select("doc", "dl", rng.alias("rng"), "t").write.parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs")
        # a range lies whole in a file, so its blocks are made where it is read; one shuffle deals them out by token
        schema = f"token string, rng long, docs array<{self.kind}>, tfs array<int>, dls array<int>, n int, max_tf int, min_dl int"
        blocks = docs.select("doc", "dl", "rng", "t").mapInArrow(_blocks_of, schema).repartition("token", "rng")
        blocks.sortWithinPartitions("token", "rng").write.option("parquet.block.size", 8 << 20).parquet(f"{at}/postings")
        self.spark.read.parquet(f"{at}/postings").groupBy("token").agg(F.sum("n").alias("df")).write.parquet(f"{at}/terms")
        return name, docs.count()

    def document_frequencies(self, m: Manifest) -> DataFrame:
        """token, df over live documents."""
        terms = self._table("terms", [s for s, *_ in m.segments])
        if terms is None:
            return self.spark.createDataFrame([], "token string, df long")
        terms = terms.select("token", "df")
        dead = self._dead(m)
        if dead is not None:
            gone = self._table("docs", [s for s, *_ in m.segments]).join(dead, ["segment", "doc"], "left_semi").select(F.explode(F.array_distinct("t")).alias("token"))
            terms = terms.union(gone.groupBy("token").agg((-F.count(F.lit(1))).alias("df")))
        return terms.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def _measured(self, m: Manifest) -> Manifest:
        """m with its statistics."""
        live = self.live(m).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        raw = F.log(live["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = self.document_frequencies(m).agg(F.avg(raw)).first()[0]
        return Manifest(m.version, m.segments, live["n"], live["tokens"], mean or 0.0, m.source, m.dead)

    def add(self, docs: DataFrame, tokens: Column, batch: str | None = None, source: str = "") -> Manifest:
        """A new version with these documents (key, ...); those of known keys replace the older ones.

        A batch that a version holds already changes nothing. Of several rows of one key the one of
        most tokens counts. A null key is no document.
        """
        m = self.manifest()
        if batch is not None and any(batch in b for *_, b in m.segments):
            return m
        name, n = self._write_segment(_forward(docs, self.key, self.kind, tokens))
        dead = m.dead
        if m.segments:
            new = self.spark.read.parquet(f"{self.path}/segments/{name}/docs").select("doc")
            older = self.live(m).select("segment", "doc").join(new, "doc", "left_semi").select("segment", "doc")
            mark = f"d{uuid.uuid4().hex}"
            older.write.parquet(f"{self.path}/dead/{mark}")
            if not self.spark.read.parquet(f"{self.path}/dead/{mark}").isEmpty():
                dead = (*m.dead, mark)
        return self._commit(self._measured(Manifest(m.version + 1, (*m.segments, (name, n, [batch or name])), source=source or m.source, dead=dead)))

    def compact(self, tier: int = TIER) -> Manifest:
        """A version in which segments of like size are one, if there are ``tier`` of them; replaced documents go."""
        m = self.manifest()
        by_size: dict[int, list[tuple[str, int, list[str]]]] = {}
        for s in m.segments:
            by_size.setdefault(int(math.log(max(s[1], 1), tier)), []).append(s)
        joined = next((group for _, group in sorted(by_size.items()) if len(group) >= tier), None)
        if joined is None:
            return m
        names = {s for s, *_ in joined}
        rest = tuple(s for s in m.segments if s[0] not in names)
        rows = self.live(m).where(F.col("segment").isin(*names)).select("doc", "dl", "t")
        name, n = self._write_segment(rows.repartition("doc"))
        dead = m.dead
        if dead:
            mark = f"d{uuid.uuid4().hex}"
            self._dead(m).where(~F.col("segment").isin(*names)).write.parquet(f"{self.path}/dead/{mark}")
            dead = (mark,)
        batches = [b for *_, held in joined for b in held]
        return self._commit(self._measured(Manifest(m.version + 1, (*rest, (name, n, batches)), source=m.source, dead=dead)))

    # --- reading

    def search(self, queries: DataFrame, tokens: Column, query: str = "item_id", top: int = 50, first: int = FIRST) -> DataFrame:
        """(query, doc, score, rank from 0) of the best documents with a positive score, as bm25() over all documents."""
        return ranked(self._scored(queries, tokens, query, top, first)[0], query, "score", self.key, top)

    def skipped(self, queries: DataFrame, tokens: Column, query: str = "item_id", top: int = 50, first: int = FIRST) -> dict[str, int]:
        """How many postings the queries' tokens have, each query's counted, and how many of them are read."""
        if not self.manifest().n:
            return {"postings": 0, "read": 0}
        _, asked, chosen = self._scored(queries, tokens, query, top, first)
        blocks = self._blocks(self.manifest(), asked).select("segment", "rng", "token", "n").join(asked.select(query, "token"), "token")
        every = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        read = blocks.join(chosen, [query, "segment", "rng"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return {"postings": every, "read": read}

    def _blocks(self, m: Manifest, asked: DataFrame) -> DataFrame:
        """Blocks of the tokens that queries hold. Few tokens are named to the scan, which skips row groups by them."""
        blocks = self._table("postings", [s for s, *_ in m.segments])
        names = [r[0] for r in asked.select("token").distinct().limit(NAMED + 1).collect()]
        return blocks.where(F.col("token").isin(*names)) if len(names) <= NAMED else blocks

    def _scored(self, queries: DataFrame, tokens: Column, query: str, top: int, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(query, doc, score) of all documents that can be among the first; the queries' tokens; the ranges read."""
        m = self.manifest()
        kind = queries.schema[query].dataType.simpleString()
        if not m.segments or not m.n:
            none = lambda schema: self.spark.createDataFrame([], schema)
            return none(f"{query} {kind}, {self.key} {self.kind}, score double"), none(f"{query} {kind}, token string, weight double"), none(f"{query} {kind}, segment string, rng long")
        asked = queries.select(query, F.explode(tokens).alias("token")).groupBy(query, "token").agg(F.count(F.lit(1)).alias("qf"))
        raw = F.log(m.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.lit(EPSILON * m.mean_idf)).otherwise(raw)
        asked = stored(asked.join(self.document_frequencies(m), "token").select(query, "token", (F.col("qf") * idf).alias("weight")))
        part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(m.mean_length or 1))))
        blocks = self._blocks(m, asked)
        dead = self._dead(m)

        def score(ranges: DataFrame | None) -> DataFrame:
            hits = blocks.join(asked, "token")
            hits = hits if ranges is None else hits.join(ranges, [query, "segment", "rng"])
            each = hits.select(query, "segment", "weight", F.inline(F.arrays_zip("docs", "tfs", "dls"))).withColumnRenamed("docs", "doc")
            each = each if dead is None else each.join(dead, ["segment", "doc"], "left_anti")
            got = each.groupBy(query, "doc").agg(F.round(F.sum(F.col("weight") * part(F.col("tfs"), F.col("dls"))), 6).alias("score"))
            return got.where("score > 0").withColumnRenamed("doc", self.key)

        if m.n <= FEW * RANGE:
            return score(None), asked, blocks.select("segment", "rng", "token").join(asked, "token").select(query, "segment", "rng").distinct()
        # what a document of a range can have at most: columns of lists are not read for it
        bound = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * part(F.col("max_tf"), F.col("min_dl")))
        bounds = blocks.select("segment", "rng", "token", "max_tf", "min_dl").join(asked, "token").groupBy(query, "segment", "rng").agg(bound.alias("bound"))
        bounds = stored(bounds)
        most = max(first, -(-first * top // RANGE))
        seeds = ranked(bounds.withColumn("at", F.concat_ws(":", "segment", "rng")), query, "bound", "at", most).select(query, "segment", "rng")
        early = stored(score(seeds))
        reached = early.withColumn("n", F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc()))).where(F.col("n") <= top)
        reached = reached.groupBy(query).agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
        rest = bounds.join(reached, query, "left").where(F.col("bound") + _SLACK >= F.coalesce("least", F.lit(0.0))).select(query, "segment", "rng")
        rest = rest.join(seeds, [query, "segment", "rng"], "left_anti")
        return early.union(score(rest)), asked, seeds.union(rest)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc, dl, rng, t), a range at a time. One that a batch's end cuts gets two blocks a token, whose bounds add up to no less."""
    for b in batches:
        rng = b.column("rng").to_numpy()
        edges = np.r_[0, np.nonzero(rng[1:] != rng[:-1])[0] + 1, len(rng)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            rows = b.slice(start, stop - start)
            rows = rows.take(pc.sort_indices(rows.column("doc")))
            lists = rows.column("t")
            words = pc.dictionary_encode(lists.flatten())
            if not len(words):
                continue
            key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(rows) + pc.list_parent_indices(lists).to_numpy(), return_counts=True)
            code, row, tf = key // len(rows), key % len(rows), tf.astype(np.int32)
            first = np.nonzero(np.r_[True, code[1:] != code[:-1]])[0]  # of each token
            dl = rows.column("dl").to_numpy()[row]
            listed = lambda values, at=np.r_[first, len(key)]: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            columns = {
                "token": words.dictionary.take(pa.array(code[first])), "rng": pa.array(np.full(len(first), rng[start])),
                "docs": listed(rows.column("doc").take(pa.array(row))), "tfs": listed(pa.array(tf)), "dls": listed(pa.array(dl)),
                "n": pa.array(np.diff(np.r_[first, len(key)]), pa.int32()), "max_tf": pa.array(np.maximum.reduceat(tf, first)), "min_dl": pa.array(np.minimum.reduceat(dl, first)),
            }
            yield pa.RecordBatch.from_pydict(columns)


def _forward(docs: DataFrame, key: str, kind: str, tokens: Column) -> DataFrame:
    """(doc, dl, t) of documents, one row a key: of several the one of most tokens. Rows are dealt out once."""
    rows = docs.where(F.col(key).isNotNull()).repartition(key).select(F.col(key).cast(kind).alias("doc"), tokens.alias("t")).withColumn("dl", F.size("t"))
    w = W.partitionBy("doc").orderBy(F.col("dl").desc(), F.col("t"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc", "dl", "t")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """What tells one state of source files from another: their names, lengths and times."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return ";".join(sorted(out))


def of_source(spark: SparkSession, path: str, docs: DataFrame, tokens: Column, source: str, key: str = "doc_id") -> Index:
    """The index below path, built anew if it is not there or was built from another state of its source."""
    index = Index(spark, path, key, docs.schema[key].dataType.simpleString())
    m = index.manifest()
    if not m.segments or m.source != source:
        name, n = index._write_segment(_forward(docs, key, index.kind, tokens))
        index._commit(index._measured(Manifest(m.version + 1, ((name, n, [source]),), source=source)))
    return index
