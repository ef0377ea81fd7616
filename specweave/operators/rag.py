"""Evidence, answers and their checks. Models stand behind callables; everything else is joins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import cut
from ..functions import notation, text
from . import graph

ANSWER = (
    "direct_recommendations array<struct<standard_id:string,reason:string>>, "
    "related_standards array<struct<standard_id:string,relationship:string,related_to:string>>, warnings array<string>, confidence string"
)
NAMED_TERMS = 6


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """prompts with answer, from a model that takes a batch of prompts."""
    schema = f"{prompts._jdf.schema().toDDL()}, answer string"

    def run(batches):
        for b in batches:
            yield b.assign(answer=model(b[prompt].tolist()))

    return prompts.mapInPandas(run, schema)


def in_order(*models: Callable[[list[str]], list[str]]) -> Callable[[list[str]], list[str]]:
    """A model that asks several in order: prompts that one fails on, or says nothing to, go to the next. What none answers is an empty text."""

    def ask(prompts: list[str]) -> list[str]:
        said: list[str] = [""] * len(prompts)
        for model in models:
            open_ = [i for i, s in enumerate(said) if not s]
            if not open_:
                break
            try:
                got = list(model([prompts[i] for i in open_]))
            except Exception:  # a model that is away must not cost the answer
                continue
            for i, text_ in zip(open_, got, strict=False):
                said[i] = text_ or ""
        return said

    return ask


def parse_answer(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with parsed (a struct of ANSWER) and parse_error; nothing raises."""
    raw = text.json_object(answer)
    out = answers.withColumn("parsed", F.from_json(raw, ANSWER, {"mode": "PERMISSIVE"}))
    bad = raw.isNull() | F.col("parsed").isNull() | F.try_parse_json(raw).isNull() | ~text.one_object(raw)
    return out.withColumn("parse_error", F.coalesce(bad, F.lit(True)))


def check_recommendations(recommended: DataFrame, evidence: DataFrame) -> DataFrame:
    """recommended (query_id, standard_id, reason) with reject_reason, null for those that hold."""
    known = evidence.select("query_id", F.col("is_number").alias("standard_id"), "title").dropDuplicates(["query_id", "standard_id"]).withColumn("known", F.lit(True))
    out = recommended.join(known, ["query_id", "standard_id"], "left")
    reason = F.when(F.col("known").isNull(), "not in evidence").when(text.cites_unknown_clause(F.col("reason"), F.col("title")), "clause not in evidence")
    return out.withColumn("reject_reason", reason).drop("known", "title")


def check_triples(claimed: DataFrame, triples: DataFrame, evidence: DataFrame) -> DataFrame:
    """claimed (query_id, s, rel, t) with reject_reason: ends must be known, the triple must exist either way round."""
    ids = evidence.select("query_id", F.col("is_number").alias("id")).union(triples.select("query_id", "t")).distinct()
    either = triples.select("query_id", "s", "rel", "t").union(triples.select("query_id", F.col("t"), "rel", F.col("s"))).distinct().withColumn("found", F.lit(True))
    out = claimed.join(ids.select("query_id", F.col("id").alias("s"), F.lit(True).alias("s_known")), ["query_id", "s"], "left")
    out = out.join(ids.select("query_id", F.col("id").alias("t"), F.lit(True).alias("t_known")), ["query_id", "t"], "left").join(either, ["query_id", "s", "rel", "t"], "left")
    reason = F.when(F.col("s_known").isNull(), "unknown standard").when(F.col("t_known").isNull(), "unknown related").when(F.col("found").isNull(), "relation not found")
    return out.withColumn("reject_reason", reason).drop("s_known", "t_known", "found")


def coverage(terms: DataFrame, evidence: DataFrame) -> DataFrame:
    """terms (query_id, seq, term) with covered_by, the first evidence (by rank) whose squashed text has the term.

    evidence: query_id, rank, is_number, text. Only one query's rows meet.
    """
    e = evidence.select("query_id", "rank", "is_number", text.squash("text").alias("hay"))
    t = terms.withColumn("needle", text.squash("term")).where("needle <> ''")
    hits = t.join(e, "query_id").where(F.contains("hay", F.col("needle"))).groupBy("query_id", "seq").agg(F.min(F.struct("rank", "is_number")).alias("hit"))
    return t.join(hits, ["query_id", "seq"], "left").select("query_id", "seq", "term", F.col("hit.is_number").alias("covered_by"))


def coverage_warning(covered: DataFrame, named: int = NAMED_TERMS) -> DataFrame:
    """One line for each query that has terms without evidence."""
    missing = covered.where("covered_by is null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "term"))).alias("m"))
    names = F.array_join(F.transform(F.slice("m", 1, named), lambda x: x["term"]), ", ")
    more = F.when(F.size("m") > named, F.concat(F.lit(" and "), (F.size("m") - named).cast("string"), F.lit(" more"))).otherwise("")
    return missing.select("query_id", F.concat(F.lit("not named by any evidence: "), names, more).alias("warning"))


def capped(relations: DataFrame, group: list[str], order: list[Column], most: int = 5) -> DataFrame:
    """First rows of each group with the number left out."""
    w = W.partitionBy(*group)
    out = relations.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("left_out", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return out.where(F.col("n") <= most)


def context(evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id and the prompt's three sections: evidence, metadata, relations."""
    ordered = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    meta = F.array_join(F.filter(F.array(*[F.when(~text.is_missing(c), F.concat(F.lit(f"{c}="), F.col(c))) for c in ("aspect", "status")]), lambda x: x.isNotNull()), "; ")
    top = evidence.groupBy("query_id").agg(ordered(F.concat_ws(" ", F.concat(F.lit("["), F.col("is_number"), F.lit("]")), "title")).alias("e"), ordered(F.concat_ws(": ", "is_number", meta)).alias("m"))
    kg = relations.withColumn("rank", F.col("n")).groupBy("query_id").agg(ordered(F.concat_ws(" ", "s", "rel", "t")).alias("k"))
    body = F.concat(F.lit("RETRIEVED EVIDENCE\n"), F.col("e"), F.lit("\n\nMETADATA\n"), F.col("m"), F.lit("\n\nKNOWLEDGE GRAPH\n"), F.coalesce("k", F.lit("(none)")))
    return top.join(kg, "query_id", "left").select("query_id", body.alias("context"))


def health(items: DataFrame, cited: DataFrame) -> DataFrame:
    """One row for a document set: items, cited standards by number, those current, and those not (unknown counts as not)."""
    key = F.coalesce("is_number", "cited_as")
    last = cited.withColumn("key", key).groupBy("doc_id", "key").agg(F.max_by("status", "seq").alias("status"))
    per = last.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.coalesce(F.col("status") == "current", F.lit(False))).alias("current"))
    n = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n_cited") == 0).alias("items_without"))
    out = n.join(per, "doc_id", "left").fillna(0, ["cited", "current"])
    return out.withColumn("outdated", F.col("cited") - F.col("current"))


def empty_answer(query: Column) -> Column:
    """What a query without evidence gets, with no model call."""
    return F.to_json(F.struct(query.alias("query"), F.array().cast("array<string>").alias("direct_recommendations"), F.array(F.lit("no evidence was retrieved")).alias("warnings"), F.lit("low").alias("confidence")))


def stub_model(prompts: list[str]) -> list[str]:
    """A model for tests: recommends the first bracketed standard of the prompt."""
    out = []
    for p in pd.Series(prompts, dtype="string").fillna(""):
        name = p[p.find("[") + 1 : p.find("]")] if "[" in p else ""
        out.append('{"direct_recommendations": [' + (f'{{"standard_id": "{name}", "reason": "first in evidence"}}' if name else "") + '], "related_standards": [], "warnings": [], "confidence": "low"}')
    return out


# --- the whole chain -----------------------------------------------------------------------

RULES = (
    "Recommend standards for the request from the evidence below, and nothing else.",
    "Name a standard only if its number stands in the evidence. Cite no clause or section of it.",
    "State a relation only if the knowledge graph lists it.",
    "Keep what was retrieved apart from what is only related, and give a reason from the evidence for each.",
    "Say so where evidence is weak or missing, and where a standard is withdrawn.",
    "Imply no value that the evidence does not hold.",
    'Answer with one JSON object: {"direct_recommendations": list of {"standard_id", "reason"}, "related_standards": list of {"standard_id", "relationship", "related_to"}, "warnings": list of text, "confidence": text}',
)
NO_EVIDENCE = "no standard was found for this query: it may be too vague, out of scope, or worded unlike any title"


def prompts(queries: DataFrame, contexts: DataFrame, query: str = "query") -> DataFrame:
    """query_id and prompt of the queries that have a context. The evidence comes first: numbers in brackets stand there alone."""
    head = F.lit("\n".join(f"{i}. {r}" for i, r in enumerate(RULES, 1)).replace("[", "(").replace("]", ")"))
    return queries.join(contexts, "query_id").select("query_id", F.concat_ws("\n\n", head, F.concat(F.lit("REQUEST\n"), F.col(query)), "context").alias("prompt"))


def with_facts(related: DataFrame, nodes: DataFrame) -> DataFrame:
    """related (standard_id) with the title and status that the data have for it, whatever the model said."""
    facts = nodes.select(F.col("is_number").alias("standard_id"), "title", "status").dropDuplicates(["standard_id"])
    return related.join(facts, "standard_id", "left")


def run(queries: DataFrame, retrieved: DataFrame, nodes: DataFrame, edges: DataFrame, model: Callable[[list[str]], list[str]], most: int = 5) -> DataFrame:
    """query_id, recommendations, related, warnings, confidence, n_evidence, rejected of every query (query_id, query).

    retrieved: query_id, kys_id, rank. Evidence is hydrated and expanded by the graph (newest
    editions, the first ``most`` of a relation), written into a prompt, answered in batches,
    parsed and checked: what the evidence does not bear out is dropped and counted. Queries
    without evidence get no prompt. Terms that no evidence names are warned of.
    """
    evidence = retrieved.join(nodes.select("kys_id", "is_number", "title", "aspect", "status"), "kys_id")
    near = graph.neighbours(evidence.select("kys_id"), edges).select("src", "rel", F.col("dst").alias("kys_id")).withColumn("seq", F.col("kys_id"))
    pruned = graph.prune_editions(graph.annotate(near, nodes)).select("src", "rel", "kys_id")
    names = nodes.select("kys_id", F.col("is_number").alias("t"))
    relations = capped(pruned.join(names, "kys_id"), ["src", "rel"], [F.col("t"), F.col("kys_id")], most)
    relations = relations.join(evidence.select("query_id", F.col("kys_id").alias("src"), F.col("is_number").alias("s"), "rank"), "src")
    line = W.partitionBy("query_id").orderBy("rank", "rel", "t")
    triples = relations.select("query_id", "s", "rel", "t", F.row_number().over(line).alias("n"))
    asked = prompts(queries, context(evidence, triples))
    # written once: recommendations, relations and warnings come from one answer, and each query is asked once
    answers = parse_answer(cut(generate(asked, model).select("query_id", "answer"))).select("query_id", "parsed", "parse_error")
    direct = check_recommendations(answers.select("query_id", F.inline("parsed.direct_recommendations")), evidence)
    claims = answers.select("query_id", F.inline("parsed.related_standards")).select("query_id", F.col("related_to").alias("s"), F.col("relationship").alias("rel"), F.col("standard_id").alias("t"))
    related = with_facts(check_triples(claims, triples, evidence).withColumnRenamed("t", "standard_id"), nodes)
    listed = lambda df, name, *cols: df.where("reject_reason is null").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias(name))
    refused = direct.select("query_id", "reject_reason").union(related.select("query_id", "reject_reason")).where("reject_reason is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("rejected"))
    terms = queries.select("query_id", F.posexplode(notation.spec_term_items(F.col("query"))).alias("seq", "x")).select("query_id", "seq", "x.term")
    seen = evidence.select("query_id", "rank", "is_number", F.concat_ws(" ", "title", "aspect").alias("text"))
    uncovered = coverage_warning(coverage(terms, seen)).withColumnRenamed("warning", "uncovered")
    out = queries.join(evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence")), "query_id", "left").join(answers, "query_id", "left")
    for part in (listed(direct, "recommendations", "standard_id", "reason"), listed(related, "related", "standard_id", "rel", F.col("s").alias("related_to"), "title", "status"), refused, uncovered):
        out = out.join(part, "query_id", "left")
    none, broken = F.col("n_evidence").isNull(), F.coalesce("parse_error", F.lit(False))
    said = F.coalesce("parsed.warnings", F.array().cast("array<string>"))
    rejections = F.when(F.col("rejected") > 0, F.concat(F.col("rejected").cast("string"), F.lit(" claims were not borne out by the evidence and are left out")))
    warnings = F.array_compact(F.concat(said, F.array(rejections, F.when(~none, F.col("uncovered")), F.when(none, F.lit(NO_EVIDENCE)), F.when(broken, F.lit("the answer could not be read")))))
    confidence = F.when(none, "insufficient_evidence").when(broken, "low").otherwise(F.coalesce("parsed.confidence", F.lit("low")))
    return out.select("query_id", "recommendations", "related", warnings.alias("warnings"), confidence.alias("confidence"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def evidence_of(recommended: DataFrame, evidence: DataFrame) -> DataFrame:
    """recommended (query_id, standard_id, evidence_tag) with the rank of its evidence: by tag, else by number, the first of each."""
    by_tag = evidence.groupBy("query_id", F.col("tag").alias("evidence_tag")).agg(F.min("rank").alias("tag_rank"))
    by_number = evidence.groupBy("query_id", F.col("is_number").alias("standard_id")).agg(F.min("rank").alias("number_rank"))
    out = recommended.join(by_tag, ["query_id", "evidence_tag"], "left").join(by_number, ["query_id", "standard_id"], "left")
    return out.withColumn("rank", F.coalesce("tag_rank", "number_rank")).drop("tag_rank", "number_rank")
