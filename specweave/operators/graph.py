"""Property graph operators over edge tables (src, rel, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import tasks_for

REVERSED = {"REFERENCES": "REFERENCED_BY", "REPLACED_BY": "REPLACES"}
MAX_HOPS = 5
#: Stored bytes of edges that one task sorts or tells apart.
SHARE = 4 << 20


def load_edges(edges: DataFrame, nodes: DataFrame, key: str = "kys_id") -> DataFrame:
    """Distinct edges whose two ends exist. Ids are hashed, edges pass by; a task tells those of one share of the stored bytes apart."""
    ids = nodes.select(F.col(key).alias("id")).distinct().hint("shuffle_hash")
    e = edges.where("src is not null and dst is not null")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("src", "rel", "dst").repartition(tasks_for(edges, SHARE), "src", "dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges, and the relations that read the other way, seen from the other end."""
    back = edges.where(F.col("rel").isin(*REVERSED))
    name = F.create_map(*[F.lit(x) for kv in REVERSED.items() for x in kv])[F.col("rel")]
    return edges.select("src", "rel", "dst").union(back.select(F.col("dst"), name, F.col("src")))


def neighbours(seeds: DataFrame, edges: DataFrame, key: str = "kys_id") -> DataFrame:
    """(src, rel, dst) one hop from the seeds, in both directions, each once."""
    return both_ways(edges).join(seeds.select(F.col(key).alias("src")).distinct(), "src", "left_semi").select("src", "rel", "dst").distinct()


def counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


def two_hop(edges: DataFrame, nodes: DataFrame, key: str = "kys_id") -> DataFrame:
    """References to withdrawn nodes with what replaced them: (src, middle, dst)."""
    gone = nodes.where("status = 'withdrawn'").select(F.col(key).alias("middle")).distinct().hint("shuffle_hash")
    a = edges.where("rel = 'REFERENCES'").select("src", F.col("dst").alias("middle"))
    b = edges.where("rel = 'REPLACED_BY'").select(F.col("src").alias("middle"), "dst")
    a = a.join(gone, "middle", "left_semi").repartition(tasks_for(edges, SHARE), "middle")
    return a.join(b, "middle").select("src", "middle", "dst").distinct()


def successors(nodes: DataFrame, key: str = "kys_id", next_: str = "replaced_by_id", hops: int = MAX_HOPS) -> DataFrame:
    """(start, final, hops, reached) of each node with a successor: the first current node on its chain.

    At most ``hops`` steps, unrolled as joins; a node seen before ends the chase.
    """
    link = nodes.select(F.col(key).alias("n"), F.col(next_).alias("m"), "status")
    state = link.where("m is not null").select(F.col("n").alias("start"), F.col("m").alias("at"), F.array("n", "m").alias("path"), F.lit(1).alias("hops"))
    done = None
    for i in range(hops):
        known = state.join(link.withColumnRenamed("n", "at"), "at", "left")
        stop = (F.col("status") == "current") | F.col("m").isNull() | F.array_contains("path", F.col("m")) | F.lit(i == hops - 1)
        known = known.withColumn("stop", F.coalesce(stop, F.lit(True)))
        ended = known.where("stop").select("start", F.col("at").alias("final"), "hops", F.coalesce(F.col("status") == "current", F.lit(False)).alias("reached"))
        done = ended if done is None else done.union(ended)
        state = known.where("not stop").select("start", F.col("m").alias("at"), F.concat("path", F.array("m")).alias("path"), (F.col("hops") + 1).alias("hops"))
    return done


def parts_of(bases: DataFrame, index: DataFrame, base: str = "base", indexed: str = "is_base_id", most: int = 3) -> DataFrame:
    """First parts "base (..." of bare numbers; an equi-join on what stands before the bracket."""
    heads = index.select(F.col(indexed).alias("part"), F.substring_index(indexed, " (", 1).alias(base)).where(F.instr("part", " (") > 0).distinct()
    found = bases.select(base).distinct().where(F.instr(base, "(") == 0).join(heads, base)
    ranked = found.withColumn("n", F.row_number().over(W.partitionBy(base).orderBy("part"))).where(F.col("n") <= most)
    return ranked.groupBy(base).agg(F.array_join(F.array_sort(F.collect_list("part")), ", ").alias("parts"))


def replaced(bases: DataFrame, index: DataFrame, editions: DataFrame, base: str = "base") -> DataFrame:
    """base and replacement, the indexed base id that the newest edition of a base was replaced by. Editions without a year come first."""
    newest = editions.where(F.col("is_base_id").isNotNull()).withColumn("n", F.row_number().over(W.partitionBy("is_base_id").orderBy(F.col("is_year").desc_nulls_last(), F.col("kys_id").desc()))).where("n = 1")
    to = editions.select(F.col("kys_id").alias("replaced_by_id"), F.col("is_base_id").alias("replacement")).join(index.select(F.col("is_base_id").alias("replacement")).distinct(), "replacement", "left_semi")
    return bases.select(base).distinct().join(newest.select(F.col("is_base_id").alias(base), "replaced_by_id"), base).join(to, "replaced_by_id").select(base, "replacement")


def resolve(bases: DataFrame, index: DataFrame, all_editions: DataFrame, base: str = "base") -> DataFrame:
    """(base, kys_id, status, parts, outcome): in the index, else the newest edition ever, else its parts, else nothing."""
    here = index.select(F.col("is_base_id").alias(base), F.col("kys_id").alias("i_id"))
    w = W.partitionBy("is_base_id").orderBy(F.col("is_year").desc_nulls_last(), F.col("kys_id").desc())
    old = all_editions.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("is_base_id").alias(base), F.col("kys_id").alias("l_id"), F.col("status").alias("l_status"))
    asked = bases.select(base).distinct()
    out = asked.join(here, base, "left").join(old, base, "left").join(parts_of(asked, index, base), base, "left")
    outcome = F.when(F.col("i_id").isNotNull(), "current").when(F.col("l_id").isNotNull(), "withdrawn").when(F.col("parts").isNotNull(), "split into parts").otherwise("not found")
    return out.select(base, F.coalesce("i_id", "l_id").alias("kys_id"), F.when(F.col("i_id").isNotNull(), "current").otherwise(F.col("l_status")).alias("status"), F.when(F.col("i_id").isNull(), F.col("parts")).alias("parts"), outcome.alias("outcome"))


def prune_editions(relations: DataFrame, order: str = "seq") -> DataFrame:
    """One relation for each (src, rel, base): current before newest before latest id; rows without base stay, last.

    relations: src, rel, kys_id, is_base_id, is_year, status and a column of first-seen order.
    """
    best = W.partitionBy("src", "rel", "is_base_id").orderBy((F.lower(F.coalesce("status", F.lit(""))) == "current").desc(), F.coalesce("is_year", F.lit(-1)).desc(), F.col("kys_id").desc())
    seen = W.partitionBy("src", "rel", "is_base_id")
    grouped = relations.where("is_base_id is not null and is_base_id <> ''").withColumn("n", F.row_number().over(best)).withColumn("seen", F.min(order).over(seen)).where("n = 1")
    rest = relations.where("is_base_id is null or is_base_id = ''")
    cols = ["src", "rel", "kys_id", "is_base_id", "is_year", "status"]
    return grouped.select(*cols, "seen", F.lit(0).alias("last")).union(rest.select(*cols, F.col(order), F.lit(1)))


def subgraph(found: DataFrame, retrieved: DataFrame, nodes: DataFrame, key: str = "kys_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (retrieved wins) and distinct edges of a response; reversed relations are turned back."""
    back = {v: k for k, v in REVERSED.items()}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[F.col("rel")], F.col("rel"))
    turned = F.col("rel").isin(*back)
    edges = found.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("source"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("target"), name.alias("relationship")).distinct()
    ids = retrieved.select(F.col(key), F.lit(True).alias("retrieved")).union(found.select("dst", F.lit(False))).groupBy(key).agg(F.max("retrieved").alias("retrieved"))
    return ids.join(nodes, key, "left").select(key, "title", "status", "retrieved"), edges


def card(candidates: DataFrame, edges: DataFrame, nodes: DataFrame, key: str = "kys_id", most: int = 12) -> DataFrame:
    """Each candidate's first references and totals, and how many of them are withdrawn."""
    refs = edges.where("rel = 'REFERENCES'").join(candidates.select(F.col(key).alias("src")).distinct(), "src", "left_semi")
    refs = refs.join(nodes.select(F.col(key).alias("dst"), "status"), "dst", "left")
    w = W.partitionBy("src").orderBy("dst")
    refs = refs.withColumn("n", F.row_number().over(w))
    return refs.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("dst")))), lambda x: x.cast("string")), ",").alias("first_refs"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "withdrawn").alias("withdrawn"))


def references(previews: DataFrame, editions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each reference a page lists: what it was read as, the edition it means, and why there is none.

    previews: kys_id, scope_status, normative_refs ("; " between). Pages of another standard
    and references listed twice by one page are left out. in_edges says whether some edition
    of the citing standard refers to some edition of the cited one.
    """
    w = W.partitionBy("is_base_id").orderBy((F.col("status") == "current").desc(), F.coalesce("is_year", F.lit(-1)).desc(), F.col("kys_id").desc())
    latest = editions.where("is_canonical").withColumn("n", F.row_number().over(w)).where("n = 1")
    heads = latest.select(F.substring_index("is_base_id", " (", 1).alias("base"), F.lit(True).alias("has_parts")).where(F.instr("is_base_id", " (") > 0).distinct()
    heads = heads.union(latest.where("is_base_id like '%) (%'").select(F.concat(F.substring_index("is_base_id", ") (", 1), F.lit(")")), F.lit(True))).distinct()
    rows = previews.where("coalesce(scope_status, '') <> 'wrong_standard' and normative_refs is not null")
    rows = rows.select("kys_id", "scope_status", F.explode(F.array_distinct(F.transform(F.split("normative_refs", ";"), lambda x: F.trim(x)))).alias("cited_as")).where("cited_as <> ''")
    shape = r"(?i)^IS\s+(\d+)(?:\s*\(\s*Part\s*(\d+)\s*(?:/\s*Sec\s*(\d+)\s*)?\))?$"
    group = lambda n: F.regexp_extract("cited_as", shape, n)
    base = F.when(F.col("cited_as").rlike(shape), F.concat(F.lit("IS "), group(1), F.when(group(2) != "", F.concat(F.lit(" (Part "), group(2), F.lit(")"))).otherwise(""), F.when(group(3) != "", F.concat(F.lit(" (Sec "), group(3), F.lit(")"))).otherwise("")))
    rows = rows.withColumn("base", base)
    citing = editions.select("kys_id", F.col("is_base_id").alias("citing_base"), F.col("dept_code").alias("citing_dept"))
    to = latest.select(F.col("is_base_id").alias("base"), F.col("kys_id").alias("cited_id"), F.col("status").alias("cited_status"), F.col("dept_code").alias("cited_dept"))
    of = editions.select(F.col("kys_id"), "is_base_id")
    known = edges.where("rel = 'REFERENCES'").join(of.select(F.col("kys_id").alias("src"), F.col("is_base_id").alias("citing_base")), "src").join(of.select(F.col("kys_id").alias("dst"), F.col("is_base_id").alias("base")), "dst")
    known = known.select("citing_base", "base").distinct().withColumn("in_edges", F.lit(1))
    out = rows.join(citing, "kys_id").join(to, "base", "left").join(heads, "base", "left").join(known, ["citing_base", "base"], "left")
    why = F.when(F.col("base").isNull(), "unparsed (range, list or OCR damage)").when(F.col("cited_id").isNotNull(), "latest edition").when(F.col("has_parts"), "family only exists as parts").otherwise("no such standard in the dataset")
    found = F.col("cited_id").isNotNull()
    return out.select("kys_id", "cited_as", "base", "cited_id", "cited_status", F.when(found, (F.col("citing_dept") == F.col("cited_dept")).cast("int")).alias("same_dept"), F.when(found, F.coalesce("in_edges", F.lit(0))).alias("in_edges"), why.alias("resolution"))


def annotate(relations: DataFrame, nodes: DataFrame, key: str = "kys_id") -> DataFrame:
    """relations (with key) with status, base, year and, where they have none, the title of the node; unknown nodes stay as they are."""
    n = nodes.select(key, F.col("title").alias("n_title"), "status", "is_base_id", "is_year")
    out = relations.drop("status", "is_base_id", "is_year").join(n, key, "left")
    return out.withColumn("title", F.coalesce(F.col("title"), "n_title") if "title" in relations.columns else F.col("n_title")).drop("n_title")


def use_instead(nodes: DataFrame, key: str = "kys_id", next_: str = "replaced_by_id") -> DataFrame:
    """key and use_instead of withdrawn nodes: the number of the current successor, else of what replaced them first."""
    number = lambda c, name: nodes.select(F.col(key).alias(c), F.col("is_number").alias(name))
    chain = successors(nodes, key, next_).where("reached").select(F.col("start").alias(key), "final")
    gone = nodes.where("status = 'withdrawn'").select(key, F.col(next_).alias("next"))
    out = gone.join(chain, key, "left").join(number("final", "a"), "final", "left").join(number("next", "b"), "next", "left")
    return out.select(key, F.coalesce("a", "b").alias("use_instead"))


#: The order of relations on a ring, and the places it has.
RING, PLACES = ("REPLACED_BY", "REPLACES", "REFERENCES", "REFERENCED_BY"), 12


def ring(focus: DataFrame, edges: DataFrame, key: str = "kys_id", order: tuple[str, ...] = RING, places: int = PLACES) -> DataFrame:
    """src, dst, rel, place (from 0) and overflow: the neighbours drawn around each node, each once, by its first relation in order."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("rel"))
    near = neighbours(focus, edges, key).where(F.col("rel").isin(*order)).withColumn("o", at)
    once = near.groupBy("src", "dst").agg(F.min(F.struct("o", "rel")).alias("m")).select("src", "dst", "m.o", "m.rel")
    w = W.partitionBy("src")
    placed = once.withColumn("place", F.row_number().over(w.orderBy("o", "dst")) - 1).withColumn("overflow", F.greatest(F.count(F.lit(1)).over(w) - places, F.lit(0)))
    return placed.where(F.col("place") < places).select("src", "dst", "rel", "place", "overflow")


def summary(candidates: DataFrame, edges: DataFrame, nodes: DataFrame, key: str = "kys_id", most: int = 12, older: int = 6) -> DataFrame:
    """What the graph adds to each candidate: its first normative references with status and what to use instead of withdrawn ones, totals, and what it replaces.

    Columns: key, normative (array of dst, is_number, status, use_instead), normative_total,
    references_total, referenced_by_total, replaces (array of numbers). References are ordered by id.
    """
    asked = candidates.select(F.col(key).alias("src")).distinct()
    near = neighbours(candidates, edges, key)
    w = W.partitionBy("src", "rel").orderBy("dst")
    near = near.withColumn("n", F.row_number().over(w))
    known = nodes.select(F.col(key).alias("dst"), "is_number", "status").join(use_instead(nodes, key).withColumnRenamed(key, "dst"), "dst", "left")
    first = near.where(((F.col("rel") == "NORMATIVELY_REFERENCES") & (F.col("n") <= most)) | ((F.col("rel") == "REPLACES") & (F.col("n") <= older))).join(known, "dst", "left")
    normative = F.array_sort(F.collect_list(F.when(F.col("rel") == "NORMATIVELY_REFERENCES", F.struct("dst", "is_number", "status", "use_instead"))))
    replaces = F.transform(F.array_sort(F.collect_list(F.when(F.col("rel") == "REPLACES", F.struct("dst", "is_number")))), lambda x: x["is_number"])
    listed = first.groupBy("src").agg(normative.alias("normative"), replaces.alias("replaces"))
    total = lambda rel: F.count_if(F.col("rel") == rel)
    totals = near.groupBy("src").agg(total("NORMATIVELY_REFERENCES").alias("normative_total"), total("REFERENCES").alias("references_total"), total("REFERENCED_BY").alias("referenced_by_total"))
    out = asked.join(totals, "src", "left").join(listed, "src", "left").fillna(0, ["normative_total", "references_total", "referenced_by_total"])
    return out.select(F.col("src").alias(key), F.coalesce("normative", F.array().cast("array<struct<dst:bigint,is_number:string,status:string,use_instead:string>>")).alias("normative"), "normative_total", "references_total", "referenced_by_total", F.coalesce("replaces", F.array().cast("array<string>")).alias("replaces"))


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: standards, relations, relations by name, and a warning where there is nothing to relate."""
    kinds = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relations"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "rel", F.col("n").cast("string")))), ", ").alias("by_name"))
    both = nodes.agg(F.count(F.lit(1)).alias("standards")).crossJoin(kinds)  # a row each
    warning = F.when(F.col("standards") == 0, "the graph holds no standards: nothing related can be told, recommendations rest on retrieval alone").when(F.col("relations") == 0, "the graph holds no relations: nothing related can be told")
    return both.select("standards", "relations", "by_name", warning.alias("warning"))


def coded(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Rows whose codes all say something, without spaces round them."""
    cut_ = {c: F.trim(F.col(c)) for c in codes}
    condition = F.lit(True)
    for c in codes:
        condition = condition & (F.coalesce(cut_[c], F.lit("")) != "")
    return rows.where(condition).withColumns(cut_)


def is_empty(edges: DataFrame) -> bool:
    return edges.isEmpty()
