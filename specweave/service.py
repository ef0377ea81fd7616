"""What a server would call: typed requests in, JSON-ready dictionaries out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut
from .functions import language as lang
from .functions import translation
from .operators import graph, rag, search

MAX_UPLOAD = 25 << 20
SUFFIXES = (".pdf", ".txt")


class RequestError(ValueError):
    """A request that cannot be served; status is the HTTP code for it."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def check_upload(name: str, content: bytes) -> None:
    if not name.lower().endswith(SUFFIXES):
        raise RequestError(400, f"only {' and '.join(SUFFIXES)} files are read")
    if len(content) > MAX_UPLOAD:
        raise RequestError(413, "the file is larger than 25 MB")
    if not content.strip():
        raise RequestError(422, "the file is empty")


class Engine:
    """Tables of one index. index: the newest editions with lexical_text; editions: all; edges: src, rel, dst.

    parts: what a search may use besides keywords, with ``built``, the fingerprint of the texts now. models: language
    models in order of preference. translator: a translation backend. labels: curated words of the
    surface (lang, label, text).
    """

    def __init__(
        self,
        spark: SparkSession,
        index: DataFrame,
        editions: DataFrame,
        edges: DataFrame,
        this_year: int,
        parts: search.Parts | None = None,
        built: str | None = None,
        models: tuple[Callable[[list[str]], list[str]], ...] = (),
        translator: translation.Backend | None = None,
        labels: DataFrame | None = None,
    ) -> None:
        self.spark, self.index, self.editions, self.edges, self.this_year = spark, index, editions, edges, this_year
        self.parts, self.built, self.models, self.translator, self.labels = parts, built, models, translator, labels

    def _items(self, text: str) -> DataFrame:
        if not text.strip():
            raise RequestError(422, "the query is empty")
        items = search.items_of(self.spark.createDataFrame([(0, text)], "doc_id long, text string")).withColumn("item_id", F.col("pos").cast("long"))
        return cut(items)

    def _found(self, items: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
        """What is ranked for items, and the same with cited standards first."""
        ranked = cut(search.retrieve(items, self.index, self.this_year, self.parts, self.built, top=top_k))
        return ranked, cut(search.with_pins(ranked, items, self.index, self.editions, top=top_k))

    def recommend(self, text: str, top_k: int = search.FINAL) -> dict:
        """Items of a text with their candidates, and the neighbours of those. Its size is the answer's, not the corpus's."""
        items = self._items(text)
        ranked, pinned = self._found(items, top_k)
        why = [c for c in ("tier", "why") if c in ranked.columns]
        out = pinned.join(self.index.select("kys_id", "is_number"), "kys_id").join(ranked.select("item_id", "kys_id", *why), ["item_id", "kys_id"], "left")
        rows = [r.asDict() for r in out.orderBy("item_id", "place").collect()]
        near = graph.neighbours(self.spark.createDataFrame([(r["kys_id"],) for r in rows] or [(None,)], "kys_id long").where("kys_id is not null"), self.edges)
        listed = [r.asDict() for r in items.orderBy("pos").select("item_id", "raw", "query", "cited").collect()]
        return {"items": listed, "candidates": rows, "related": [r.asDict() for r in near.orderBy("src", "rel", "dst").limit(100).collect()]}

    def answer(self, text: str, top_k: int = search.FINAL, language: str | None = None) -> dict:
        """Items of a text in any language with checked answers; the surface's words in ``language``, or in that of the text.

        Items are put into English for the search and the models; what evidence does not bear out is
        left out, as run() says. Without models the evidence alone is told.
        """
        items = self._items(text)
        spoken = self.spark.createDataFrame([(text, language)], "t string, lang string").select(lang.detection("t", translation.resolve_language(F.col("lang"))).alias("x")).select("x.*").first()
        told = cut(translation.translate(items.select("item_id", "query", "cited"), self.translator, "query"))
        english = told.select("item_id", "cited", F.col("english").alias("query"))
        _, pinned = self._found(english, top_k)
        nodes = self.editions if "title" in self.editions.columns else self.editions.withColumn("title", F.col("lexical_text"))
        queries = english.select(F.col("item_id").alias("query_id"), "query")
        retrieved = pinned.select(F.col("item_id").alias("query_id"), "kys_id", F.col("place").alias("rank"))
        said = rag.run(queries, retrieved, nodes, self.edges, rag.in_order(*self.models))
        rows = [r.asDict(recursive=True) for r in said.join(told.select(F.col("item_id").alias("query_id"), F.col("query").alias("item"), F.col("english").alias("asked"), "note"), "query_id").orderBy("query_id").collect()]
        return {"language": {"code": spoken["code"], "confidence": spoken["confidence"]}, "answers": rows, "labels": self.labels_in(spoken["code"])}

    def labels_in(self, code: str) -> dict[str, str]:
        """Words of the surface in a language; those it lacks stay as they are."""
        if self.labels is None:
            return {}
        every = self.labels.select("label").distinct()
        return {r["label"]: r["localized"] for r in translation.localise(every, self.labels, code).collect()}

    @staticmethod
    def languages() -> list[dict]:
        return [{"code": code, "name": name, "rtl": code in translation.RTL} for code, _, name in translation.LANGUAGES]

    def status(self) -> dict:
        """What this engine can do now: parts that are missing or stale are not there."""
        use = (self.parts or search.Parts()).usable(self.built)
        return {"standards": self.index.count(), "stored_index": use.keyword is not None, "scopes": use.scopes is not None, "semantic": use.dense is not None, "rerank": use.rerank is not None, "models": len(self.models), "translator": self.translator is not None}

    def recommend_json(self, text: str, top_k: int = search.FINAL) -> str:
        return json.dumps(self.recommend(text, top_k), ensure_ascii=False)

    def health(self, text: str) -> dict:
        items = search.items_of(self.spark.createDataFrame([(0, text)], "doc_id long, text string"))
        row = search.audit(items, self.index, self.editions).first()
        return row.asDict() if row else {"doc_id": 0, "items": 0, "items_without": 0, "cited": 0, "current": 0, "outdated": 0}
