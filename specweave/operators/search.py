"""From a document to ranked standards: items, citations, candidates, requirements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import requirements as R
from ..functions import scoring, text
from . import graph, lexical, retrieval

FINAL = 10
#: Share of a title's words that a sound scope holds.
SCOPE_OVERLAP = 0.35


def items_of(documents: DataFrame, costs: dict[str, float] | None = None, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, pos, raw, query, cited, pairs) of each line item; headings and items that say nothing are left out."""
    d = documents.select(doc, F.posexplode(D.line_items(F.col(body))).alias("pos", "item"))
    d = d.select(doc, "pos", F.col("item.text").alias("raw"), F.col("item.pairs").alias("pairs")).where(~text.is_heading("raw"))
    d = d.withColumn("query", D.query_column(F.col("raw"), costs)).withColumn("cited", text.citations("raw"))
    return d.where((F.char_length("query") >= 3) | (F.size("cited") > 0))


def candidates(items: DataFrame, index: DataFrame, this_year: int, key: str = "item_id", top: int = FINAL, extra: dict[str, DataFrame] | None = None, keyword: lexical.Index | None = None) -> DataFrame:
    """Ranked standards of each item (key, query): keyword search, fused with further ranked lists, boosted, tiered, explained.

    index: kys_id, is_number, lexical_text, aspect, mandatory_cert, is_year. extra: lists of (key, kys_id, rank).
    keyword: a stored index of lexical_text; without one the texts are read as they are.
    """
    q, d = items.select(key, F.col("query").alias("text")), index.select("kys_id", F.col("lexical_text").alias("text"))
    by_words = keyword.search(q, text.tokens("text"), key) if keyword is not None else retrieval.bm25(q, d, text.tokens("text"), text.tokens("text"), key, "kys_id")
    lists = {"keyword": by_words, **(extra or {})}
    fused = retrieval.fuse(lists, key, "kys_id").join(index, "kys_id").join(items.select(key, "query"), key)
    boosted = scoring.boost(F.col("aspect"), F.col("mandatory_cert"), F.col("is_year"), this_year)
    fused = fused.withColumn("score", scoring.combine(scoring.relevance(F.col("score"), len(lists)), boosted))
    matched = retrieval.matched_words(text.tokens("query"), text.tokens("lexical_text"))
    has = lambda s: F.array_contains(F.split("sources", ","), s)
    why = F.array_compact(F.array(
        F.when(has("keyword") & (matched != ""), F.concat(F.lit("matched "), matched)),
        F.when(has("semantic"), F.lit("semantically similar title")),
        F.when(has("scope"), F.lit("scope text matches")),
        F.when(F.lower(F.coalesce("aspect", F.lit(""))) == "product specification", F.lit("product specification")),
        F.when(F.coalesce("mandatory_cert", F.lit(False)), F.lit("mandatory certification")),
    ))
    ranked = fused.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "rank", "kys_id"))).where(F.col("place") <= top)
    return ranked.select(key, "place", "kys_id", "is_number", "score", scoring.tier(F.col("score")).alias("tier"), F.when(F.size(why) == 0, "ranked by hybrid retrieval").otherwise(F.array_join(why, "; ")).alias("why"))


def sound_scopes(previews: DataFrame) -> DataFrame:
    """Scopes that may be searched: found, not empty, and about what the title says."""
    return previews.where((F.col("scope_status") == "ok") & (F.col("title_overlap") >= SCOPE_OVERLAP) & (F.coalesce("scope_text", F.lit("")) != ""))


@dataclass(frozen=True)
class Parts:
    """What a search may use besides keywords; what is not there, or was built from other data, is left out.

    scopes: kys_id, scope_text. dense, fallback: a function from items (key, query) to a
    ranked list (key, kys_id, rank); *_built: the fingerprint of the texts they were made from.
    rerank: a function from (queries, texts) to relevances in [0, 1]. keyword: a stored index of the
    texts; its manifest says what they were.
    """

    scopes: DataFrame | None = None
    dense: Callable[[DataFrame], DataFrame] | None = None
    dense_built: str | None = None
    fallback: Callable[[DataFrame], DataFrame] | None = None
    fallback_built: str | None = None
    rerank: Callable[[list[str], list[str]], list[float]] | None = None
    keyword: lexical.Index | None = None

    def usable(self, built: str | None) -> Parts:
        """Without encoders and indexes that were made from other texts than those fingerprinted as built."""
        stale = lambda own: built is not None and own is not None and own != built
        dense = None if self.dense is None or stale(self.dense_built) else self.dense
        fallback = None if self.fallback is None or stale(self.fallback_built) else self.fallback
        keyword = None if self.keyword is None or stale(self.keyword.manifest().source) else self.keyword
        return replace(self, dense=dense, fallback=fallback, keyword=keyword)


def ranked_lists(items: DataFrame, index: DataFrame, parts: Parts, key: str = "item_id") -> dict[str, DataFrame]:
    """Ranked lists beside the keywords' that these parts give: scopes, and vectors by the encoder each line goes to."""
    out: dict[str, DataFrame] = {}
    if parts.scopes is not None:
        q, d = items.select(key, F.col("query").alias("text")), sound_or_all(parts.scopes).join(index.select("kys_id"), "kys_id", "left_semi").select("kys_id", F.col("scope_text").alias("text"))
        out["scope"] = retrieval.bm25(q, d, text.tokens("text"), text.tokens("text"), key, "kys_id")
    if parts.dense is not None:
        if parts.fallback is None:
            out["semantic"] = parts.dense(items)
        else:
            to = route(F.col("query"), True)
            out["semantic"] = parts.dense(items.where(to == "english")).unionByName(parts.fallback(items.where(to == "multilingual")))
    return out


def sound_or_all(scopes: DataFrame) -> DataFrame:
    return sound_scopes(scopes) if {"scope_status", "title_overlap"} <= set(scopes.columns) else scopes


def reranked(ranked: DataFrame, items: DataFrame, index: DataFrame, model: Callable[[list[str], list[str]], list[float]], this_year: int, key: str = "item_id", top: int = FINAL) -> DataFrame:
    """ranked (key, kys_id) scored anew by a model that reads query and document together, boosted as before."""
    rows = ranked.select(key, "kys_id").join(items.select(key, "query"), key).join(index, "kys_id")

    @F.pandas_udf("double")
    def relevance(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(model(q.tolist(), d.tolist()), dtype="float64")

    score = scoring.combine(relevance("query", "lexical_text"), scoring.boost(F.col("aspect"), F.col("mandatory_cert"), F.col("is_year"), this_year))
    rows = rows.select(key, "kys_id", "is_number", score.alias("score"))
    out = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "kys_id"))).where(F.col("place") <= top)
    return out.withColumn("tier", scoring.tier(F.col("score")))


def retrieve(items: DataFrame, index: DataFrame, this_year: int, parts: Parts | None = None, built: str | None = None, key: str = "item_id", top: int = FINAL) -> DataFrame:
    """Candidates by all that can be used: keywords always; scopes, vectors and the second reading where they are there and fresh."""
    use = (parts or Parts()).usable(built)
    found = candidates(items, index, this_year, key, top if use.rerank is None else retrieval.TOP, ranked_lists(items, index, use, key), use.keyword)
    return found if use.rerank is None else reranked(found, items, index, use.rerank, this_year, key, top)


def with_pins(ranked: DataFrame, items: DataFrame, index: DataFrame, editions: DataFrame, key: str = "item_id", top: int = FINAL) -> DataFrame:
    """Cited standards first, then indexed parts of split ones, then what was ranked."""
    cited = items.select(key, F.posexplode("cited").alias("n", "base"))
    known = graph.resolve(cited, index, editions)
    exact = cited.join(known.where("outcome = 'current'").select("base", "kys_id"), "base").select(key, "kys_id", F.lit(scoring.SCORE_CITED).alias("score"), F.col("n").alias("rank"))
    parts = cited.join(known.where("parts is not null").select("base", F.explode(F.split("parts", ", ")).alias("is_base_id")), "base").join(index.select("is_base_id", "kys_id"), "is_base_id")
    parts = parts.select(key, "kys_id", F.lit(scoring.SCORE_CITED_PART).alias("score"), (F.col("n") + F.lit(1 << 40)).alias("rank"))  # behind every exact one
    pins = exact.union(parts).groupBy(key, "kys_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    return retrieval.pin(ranked.select(key, "kys_id", "score", F.col("place").alias("rank")), pins, key, "kys_id", top)


def requirements(items: DataFrame, gazetteer: dict[str, list[str]], key: str = "item_id", raw: str = "raw") -> DataFrame:
    """key, product, material, property, environment, quantities and unmapped of each item; gazetteer: reviewed lists by kind.

    Items with a column pairs (array of struct(k, v)) are read by their keys first.
    """
    pairs = F.col("pairs") if "pairs" in items.columns else F.lit(None).cast("array<struct<k:string,v:string>>")
    return items.select(key, R.requirement_column(text.strip_citations(raw), pairs, gazetteer).alias("r")).select(key, "r.*")


def audit(items: DataFrame, index: DataFrame, editions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Health of documents by what their items cite."""
    from .rag import health

    cited = items.select(doc, "pos", F.posexplode("cited").alias("n", "base"))
    known = graph.resolve(cited, index, editions).select("base", "status")
    cited = cited.join(known, "base", "left").select(F.col(doc).alias("doc_id"), (F.col("pos") * (1 << 20) + F.col("n")).alias("seq"), F.col("base").alias("is_number"), F.col("base").alias("cited_as"), "status")
    return health(items.select(F.col(doc).alias("doc_id"), F.size("cited").alias("n_cited")), cited)


def route(c: Column, fallback_ready: bool) -> Column:
    """Which encoder a line goes to: the multilingual one from three tenths of letters beyond Latin on."""
    from ..functions.language import non_latin_share

    return F.when(F.lit(fallback_ready) & (non_latin_share(c) >= 0.3), "multilingual").otherwise("english")
