"""Retrieval: postings, BM25, exact vectors, fusion. Everything is keyed by ids, never by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import cut, tasks_for
from ..functions import scoring, text

# Fixed values of BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP = 50


def tokenised(docs: DataFrame, tokens: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, t, dl) of an index, written once and dealt out by document: what follows groups by document where it lies."""
    return cut(docs.repartition(doc).select(doc, tokens.alias("t")).withColumn("dl", F.size("t")))


def bm25_idf(index: DataFrame, n_docs: int) -> DataFrame:
    """(token, idf); terms in more than half of all documents get a share of the mean idf instead."""
    df = index.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = df.select("token", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("token", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, query_tokens: Column, doc_tokens: Column, query: str = "item_id", doc: str = "doc_id", top: int = TOP) -> DataFrame:
    """(query, doc, score, rank from 0) of the best documents with a positive score.

    Only tokens that a query holds leave the index. If those few are broadcast, counts
    and sums by document need no further shuffle; only each query's best rows move.
    """
    index = tokenised(docs, doc_tokens, doc)
    stats = index.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    asked = queries.select(query, F.explode(query_tokens).alias("token")).groupBy(query, "token").agg(F.count(F.lit(1)).alias("qf"))
    asked = cut(asked.join(bm25_idf(index, stats["n"]), "token"))
    wanted = asked.select("token").distinct()
    tf = index.select(doc, "dl", F.explode_outer("t").alias("token")).join(wanted, "token", "left_semi").groupBy(doc, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats["mean"] or 1))))
    scored = tf.join(asked, "token").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scored, query, "score", doc, top)


def ranked(scored: DataFrame, query: str, score: str, tie: str, top: int) -> DataFrame:
    """The best rows of each query with their rank from 0; ties go by id."""
    w = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    # a bare limit on row_number() lets Spark cut each task's rows before they are shuffled
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.col("rank") - 1)


def keyword_overlap(queries: DataFrame, docs: DataFrame, query: str = "item_id", doc: str = "doc_id", top: int = 5) -> DataFrame:
    """(query, doc, score, rank) by shared tokens over the geometric mean of set sizes; an equi-join on tokens."""
    words = F.array_distinct(text.ascii_tokens("text", text.OVERLAP_STOPWORDS, 2))
    q = queries.select(query, words.alias("t")).select(query, F.size("t").alias("nq"), F.explode("t").alias("token"))
    # explode_outer: a plain explode has Spark filter by the tokens' number, and so make them twice
    # a task counts the pairs of its documents and all queries, so there are as many tasks as the texts need
    d = docs.select(doc, "text")
    d = d.repartition(tasks_for(d), doc).select(doc, words.alias("t")).select(doc, F.size("t").alias("nd"), F.explode_outer("t").alias("token"))
    shared = d.join(q, "token").groupBy(query, doc, "nq", "nd").agg(F.count(F.lit(1)).alias("n"))
    scored = shared.select(query, doc, F.round(F.col("n") / F.sqrt(F.col("nq").cast("double") * F.col("nd")), 4).alias("score"))
    return ranked(scored, query, "score", doc, top)


#: Scores that are held at a time, and what rounding to six places may hide.
SCORES, ROUNDED = 1 << 20, 2e-6


def unit(rows) -> np.ndarray:
    """Vectors of a column, at length 1."""
    x = np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def best_of(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of every query (its number is in who), in order; ties go by id."""
    order = np.lexsort((ids, -scores, who))
    who = who[order]
    first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
    place = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
    kept = place < top
    return who[kept], ids[order][kept], scores[order][kept]


def near_pairs(q: np.ndarray, x: np.ndarray, ids: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, score) of rows x that can be among the first of queries whose place ``top`` scores at least ``least``.

    At most SCORES products are held at a time, however many queries and rows there are.
    """
    step, out = max(1, SCORES // max(1, len(x))), []
    for a in range(0, len(q), step):
        s = q[a : a + step] @ x.T
        floor = least[a : a + step]
        if len(x) > top and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(s, len(x) - top, axis=1)[:, len(x) - top])
        who, which = np.nonzero(s >= floor[:, None] - ROUNDED)
        out.append(best_of(who + a, ids[which], np.round(s[who, which], 6), top))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), ids[:0], np.zeros(0))


def vector_top(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, key, score, rank) by exact cosine.

    A query set of at most block_bytes goes to the vectors whole; each task multiplies its
    batches with it, a block of queries at a time, and keeps the best, so only top rows of
    tasks are shuffled. Larger ones meet the vectors in cells, see vectors.Cells.
    """
    first = queries.select(vector).first()
    most = max(1, block_bytes // (8 * max(1, len(first[vector]) if first else 1)))
    rows = queries.select(key, vector).limit(most + 1).collect()
    if len(rows) > most:
        from .vectors import Cells

        return Cells(vectors, key, vector).search(queries, top)
    kind = vectors.schema[key].dataType.simpleString()
    if not rows:
        return ranked(vectors.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score")).limit(0), "query_id", "score", key, top)
    rows.sort(key=lambda r: r[key])
    asked = np.array([r[key] for r in rows])
    q = np.array([r[vector] for r in rows], dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def best(batches):
        held, least = None, np.full(len(q), -np.inf)
        for b in batches:
            if not len(b):
                continue
            found = near_pairs(q, unit(b[vector]), b[key].to_numpy(), least, top)
            held = best_of(*(found if held is None else map(np.concatenate, zip(held, found, strict=True))), top)
            # a query that has as many rows as are asked for needs none below its last
            full = np.bincount(held[0], minlength=len(q)) >= top
            least[held[0]] = held[2]
            least[~full] = -np.inf
        if held is not None:
            yield pd.DataFrame({"query_id": asked[held[0]], key: held[1], "score": held[2]})

    return ranked(vectors.select(key, vector).mapInPandas(best, f"query_id {kind}, {key} {kind}, score double"), "query_id", "score", key, top)


def fuse(lists: dict[str, DataFrame], query: str = "item_id", doc: str = "doc_id", top: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of named ranked lists: (query, doc, score, sources, rank)."""
    every = None
    for name, one in lists.items():
        part = one.select(query, doc, scoring.rrf(F.col("rank")).alias("share"), F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy(query, doc).agg(F.round(F.sum("share"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return ranked(summed, query, "score", doc, top)


def fuse_subsets(lists: dict[str, DataFrame], query: str = "item_id", doc: str = "doc_id", top: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of every subset of the lists: (config, query, doc, score, rank).

    Each list is worked out once; its rows go to the subsets that have it. config names the
    lists, joined by "+".
    """
    names, every = list(lists), None
    configs = ["+".join(n for i, n in enumerate(names) if mask >> i & 1) for mask in range(1, 1 << len(names))]
    for name, one in lists.items():
        mine = F.array(*[F.lit(c) for c in configs if name in c.split("+")])
        part = one.select(query, doc, scoring.rrf(F.col("rank")).alias("share"), mine.alias("configs"))
        every = part if every is None else every.unionByName(part)
    summed = every.select(F.explode("configs").alias("config"), query, doc, "share").groupBy("config", query, doc).agg(F.round(F.sum("share"), 9).alias("score"))
    w = W.partitionBy("config", query).orderBy(F.col("score").desc(), F.col(doc))
    best = summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.col("rank") - 1)


def recall_by(ranked_rows: DataFrame, gold: DataFrame, configs: DataFrame, query: str = "item_id", doc: str = "doc_id", at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall() for each of configs (config); those that rank nothing have shares of 0."""
    gold = gold.select(query, doc).distinct()
    hit = ranked_rows.join(gold, [query, doc]).groupBy("config", query).agg((F.min("rank") + 1).alias("first"))
    n = gold.select(query).distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    sums = [F.count_if(F.col("first") <= k).alias(f"hits_{k}") for k in at]
    per = hit.groupBy("config").agg(*sums, F.sum(1.0 / F.col("first")).alias("gain"))
    out = configs.join(per, "config", "left").crossJoin(F.broadcast(n))
    shares = [F.round(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n"), 6).alias(f"recall_{k}") for k in at]
    return out.select("config", "n", *shares, F.round(F.coalesce("gain", F.lit(0.0)) / F.col("n"), 6).alias("mrr"))


def pin(ranked_rows: DataFrame, pinned: DataFrame, query: str = "item_id", doc: str = "doc_id", top: int = 10) -> DataFrame:
    """Pinned rows first, then the others in their order; both have query, doc, score, rank."""
    rest = ranked_rows.join(pinned.select(query, doc), [query, doc], "left_anti")
    both = pinned.select(query, doc, "score", "rank", F.lit(0).alias("group")).unionByName(rest.select(query, doc, "score", "rank", F.lit(1).alias("group")))
    w = W.partitionBy(query).orderBy("group", "rank", doc)
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(query, doc, "score", "group", "place")


def matched_words(query_tokens: Column, doc_tokens: Column, most: int = 4) -> Column:
    """The query's words that the document has, in the query's order, the first few."""
    return F.array_join(F.slice(F.array_intersect(F.array_distinct(query_tokens), doc_tokens), 1, most), ", ")


def recall(ranked_rows: DataFrame, gold: DataFrame, query: str = "item_id", doc: str = "doc_id", at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: share of queries with a gold document among the first k, and the mean reciprocal rank."""
    hit = ranked_rows.join(gold.select(query, doc).distinct(), [query, doc]).groupBy(query).agg((F.min("rank") + 1).alias("first"))
    all_ = gold.select(query).distinct().join(hit, query, "left")
    shares = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in at]
    return all_.agg(F.count(F.lit(1)).alias("n"), *shares, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def family_recall(ranked_rows: DataFrame, gold: DataFrame, query: str = "item_id", doc: str = "doc_id", family: str = "family", at: int = 5) -> DataFrame:
    """One row: share of queries whose gold family stands among the first rows. Both have family, what comes before a part."""
    best = ranked_rows.join(gold.select(query, family).distinct(), [query, family]).groupBy(query).agg((F.min("rank") + 1).alias("first"))
    all_ = gold.select(query).distinct().join(best, query, "left")
    return all_.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("first") <= at).cast("double"), F.lit(0.0))), 6).alias(f"family_recall_{at}"))


def terms_counted(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """(term, words, n) of batches of (w): words and pairs of neighbours, counted for ``rows`` texts at a time, so that what is held does not grow with a task."""
    for b in batches:
        for at in range(0, len(b), rows):
            lists = b.column(0).slice(at, rows)
            one, owner = lists.flatten(), pc.list_parent_indices(lists)
            within = pc.equal(owner[:-1], owner[1:])
            two = pc.binary_join_element_wise(one[:-1].filter(within), one[1:].filter(within), " ")
            for words, terms in ((1, one), (2, two)):
                got = pc.value_counts(terms)
                yield pa.RecordBatch.from_pydict({"term": got.field(0), "words": pa.array(np.full(len(got), words, np.int32)), "n": got.field(1)})


def mined_terms(texts: DataFrame, body: str, seeds: list[str], heads: list[str], modifiers_out: list[str], generic: list[str], reviewed_out: list[str], least: int = 25, alone: bool = False) -> DataFrame:
    """term and n of a gazetteer: seeds that the texts use, two words that end in a head word, and (alone) head words by themselves.

    A modifier has three letters at least and is none of modifiers_out; generic words and
    terms that a review took out never count.
    """
    w = texts.select(F.regexp_extract_all(F.lower(body), F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    one = w.select(F.explode("w").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("a"), "b", "n")
    two = w.where(F.size("w") > 1).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    every = one.unionByName(two).where(F.col("n") >= least).withColumn("term", F.concat_ws(" ", "a", "b"))
    headed = F.col("b").isin(heads) & F.col("a").isNotNull() & (F.char_length("a") >= 3) & ~F.col("a").isin(modifiers_out or [""])
    bare = F.lit(alone) & F.col("a").isNull() & F.col("b").isin(heads)
    out = every.where(F.col("term").isin(seeds or [""]) | headed | bare)
    return out.where(~F.col("term").isin([*generic, *reviewed_out, ""])).select("term", "n")
