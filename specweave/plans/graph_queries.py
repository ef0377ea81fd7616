"""Graph queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import readers
from .relational_queries import newest
from .tables import edges, sql, standards


def loaded(spark, d):
    return G.load_edges(edges(spark, d), standards(spark, d))


def edges_dedupe(spark, d):
    return loaded(spark, d)


def graph_counts(spark, d):
    return G.counts(G.both_ways(loaded(spark, d)))


def neighbours_all(spark, d):
    return G.neighbours(newest(spark, d), loaded(spark, d))


def two_hop_audit(spark, d):
    return G.two_hop(loaded(spark, d), standards(spark, d))


def successor_chase(spark, d):
    return G.successors(standards(spark, d))


def successor_parts(spark, d):
    bases = standards(spark, d).select(F.substring_index("is_base_id", " (", 1).alias("base"))
    return G.parts_of(bases, newest(spark, d))


def resolve_chain(spark, d):
    s = standards(spark, d)
    asked = s.select(F.col("is_base_id").alias("base")).union(s.select(F.substring_index("is_base_id", " (", 1))).union(s.select(F.concat(F.lit("IS "), (500 + F.col("kys_id") % 7).cast("string"))))
    return G.resolve(asked, newest(spark, d), s)


def edition_prune(spark, d):
    rel = loaded(spark, d).where("rel = 'REFERENCES'").join(standards(spark, d).select(F.col("kys_id").alias("dst"), "is_base_id", "is_year", "status"), "dst")
    rel = rel.select("src", "rel", F.col("dst").alias("kys_id"), F.when(F.col("dst") % 13 != 0, F.col("is_base_id")).alias("is_base_id"), "is_year", "status", F.col("dst").alias("seq"))
    return G.prune_editions(rel).select("src", "rel", "kys_id", "seen", "last")


def subgraph_edges(spark, d):
    seeds = newest(spark, d)
    return G.subgraph(G.neighbours(seeds, loaded(spark, d)), seeds, standards(spark, d))[1]


def subgraph_nodes(spark, d):
    seeds = newest(spark, d)
    return G.subgraph(G.neighbours(seeds, loaded(spark, d)), seeds, standards(spark, d))[0]


def graph_card(spark, d):
    return G.card(newest(spark, d), loaded(spark, d), standards(spark, d))


def pair_confirm(spark, d):
    e, s = loaded(spark, d), standards(spark, d)
    lift = lambda c, n: s.select(F.col("kys_id").alias(c), F.col("is_base_id").alias(n))
    pairs = e.join(lift("src", "a"), "src").join(lift("dst", "b"), "dst")
    refs = pairs.where("rel = 'REFERENCES'").select("a", "b").distinct()
    back = refs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("confirmed"))
    return refs.join(back, ["a", "b"], "left").select("a", "b", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def edition_counts(spark, d):
    s = standards(spark, d)
    return s.groupBy("is_base_id").agg(F.count(F.lit(1)).alias("editions"), F.count_if(F.col("status") == "current").alias("current"), F.max(F.coalesce("is_year", F.lit(-1))).alias("newest"))


def _five(spark, d):
    """Edges of which a part is normative."""
    e = loaded(spark, d)
    return e.withColumn("rel", F.when((F.col("rel") == "REFERENCES") & (F.col("dst") % 4 == 0), "NORMATIVELY_REFERENCES").otherwise(F.col("rel")))


def graph_summary(spark, d):
    s = G.summary(newest(spark, d), _five(spark, d), standards(spark, d))
    line = lambda x: F.concat_ws(":", x["dst"].cast("string"), x["is_number"], x["status"], x["use_instead"])
    return s.select("kys_id", F.array_join(F.transform("normative", line), "|").alias("normative"), "normative_total", "references_total", "referenced_by_total", F.array_join("replaces", "|").alias("replaces"))


def graph_description(spark, d):
    """The whole graph, one of standards that nothing relates, and one without any."""
    s, e = standards(spark, d), _five(spark, d)
    named = lambda n, x: x.select(F.lit(n).alias("graph"), "*")
    return named("whole", G.describe(s, e)).union(named("apart", G.describe(s, e.where("src < 0")))).union(named("none", G.describe(s.where("kys_id < 0"), e.where("src < 0"))))


def nodes_with_codes(spark, d):
    """Standards with department and committee, of which some are blank or null."""
    k = F.col("kys_id")
    s = standards(spark, d).select("kys_id", F.when(k % 5 != 0, F.concat(F.lit("  "), F.col("dept_code"), F.lit(" "))).alias("dept_code"), F.when(k % 7 == 0, "   ").otherwise(F.concat(F.lit("C"), (k % 9).cast("string"))).alias("committee_code"))
    return G.coded(s, ["dept_code", "committee_code"])


def fetch_wanted(spark, d):
    """What a fetch by families, by departments, and by ids asks for."""
    n = newest(spark, d)
    pick = lambda how, df: df.select(F.lit(how).alias("how"), "kys_id")
    out = pick("families", readers.wanted(n, families=["IS 101", "IS 13"])).union(pick("departments", readers.wanted(n, departments=["brand#11", "Brand#23"])))
    return out.union(pick("ids", readers.wanted(n, ids=[3, 5, 8, 13, 21, 34, 55, 89], families=["IS 101"]))).union(pick("all", readers.wanted(n)))


_BOTH = """both_ways AS (SELECT src, rel, dst FROM edges UNION ALL SELECT dst, CASE rel WHEN 'REFERENCES' THEN 'REFERENCED_BY' ELSE 'REPLACES' END, src FROM edges)"""
_NEAR = _BOTH + """, near AS (SELECT DISTINCT src, rel, dst FROM both_ways WHERE src IN (SELECT kys_id FROM newest))"""
_PARTS = """parts AS (SELECT base, string_agg(part, ', ' ORDER BY part) AS parts FROM (
  SELECT base, part, row_number() OVER (PARTITION BY base ORDER BY part) AS n FROM (SELECT DISTINCT split_part(is_base_id, ' (', 1) AS base, is_base_id AS part FROM newest WHERE contains(is_base_id, ' (')))
  WHERE n <= 3 GROUP BY base)"""

_FIVE = "five AS (SELECT src, CASE WHEN rel = 'REFERENCES' AND dst % 4 = 0 THEN 'NORMATIVELY_REFERENCES' ELSE rel END AS rel, dst FROM edges), both5 AS (SELECT * FROM five UNION SELECT dst, CASE rel WHEN 'REFERENCES' THEN 'REFERENCED_BY' ELSE 'REPLACES' END, src FROM five WHERE rel IN ('REFERENCES', 'REPLACED_BY'))"
PAIRS = {
    "nodes_with_codes": (nodes_with_codes, sql("SELECT kys_id, dept_code, 'C' || (kys_id % 9) AS committee_code FROM standards WHERE kys_id % 5 <> 0 AND kys_id % 7 <> 0")),
    "fetch_wanted": (fetch_wanted, sql("SELECT 'families' AS how, kys_id FROM newest WHERE is_base_id = 'IS 101' OR starts_with(is_base_id, 'IS 101 ') OR is_base_id = 'IS 13' OR starts_with(is_base_id, 'IS 13 ') UNION ALL SELECT 'departments', kys_id FROM newest WHERE dept_code IN ('BRAND#11', 'BRAND#23') UNION ALL SELECT 'ids', kys_id FROM newest WHERE kys_id IN (3, 5, 8, 13, 21, 34, 55, 89) UNION ALL SELECT 'all', kys_id FROM newest")),
    "graph_description": (graph_description, sql(
        "SELECT 'whole' AS graph, (SELECT count(*) FROM standards) AS standards, (SELECT count(*) FROM five) AS relations, (SELECT string_agg(rel || '=' || n, ', ' ORDER BY rel || '=' || n) FROM (SELECT rel, count(*) AS n FROM five GROUP BY rel)) AS by_name, NULL AS warning "
        "UNION ALL SELECT 'apart', (SELECT count(*) FROM standards), 0, '', 'the graph holds no relations: nothing related can be told' UNION ALL SELECT 'none', 0, 0, '', 'the graph holds no standards: nothing related can be told, recommendations rest on retrieval alone'", _FIVE)),
    "edges_dedupe": (edges_dedupe, sql("SELECT * FROM edges")),
    "graph_counts": (graph_counts, sql("SELECT rel, count(*) AS n, count(DISTINCT src) AS sources FROM both_ways GROUP BY rel", _BOTH)),
    "neighbours_five_way": (neighbours_all, sql("SELECT * FROM near", _NEAR)),
    "two_hop_audit": (two_hop_audit, sql("SELECT DISTINCT a.src, a.dst AS middle, b.dst FROM edges a JOIN standards s ON s.kys_id = a.dst AND s.status = 'withdrawn' JOIN edges b ON b.src = a.dst AND b.rel = 'REPLACED_BY' WHERE a.rel = 'REFERENCES'")),
    "successor_recursive": (successor_chase, sql(
        "SELECT start, cur AS final, hops, status = 'current' AS reached FROM c WHERE halt",
        """c(start, cur, path, hops, status, m, halt) AS (
          SELECT k.kys_id, k.replaced_by_id, [k.kys_id, k.replaced_by_id], 1, n.status, n.replaced_by_id, n.kys_id IS NULL OR n.status = 'current' OR n.replaced_by_id IS NULL OR list_contains([k.kys_id, k.replaced_by_id], n.replaced_by_id)
          FROM standards k LEFT JOIN standards n ON n.kys_id = k.replaced_by_id WHERE k.replaced_by_id IS NOT NULL
          UNION ALL
          SELECT c.start, c.m, list_append(c.path, c.m), c.hops + 1, n.status, n.replaced_by_id, n.kys_id IS NULL OR n.status = 'current' OR n.replaced_by_id IS NULL OR list_contains(list_append(c.path, c.m), n.replaced_by_id) OR c.hops + 1 = 5
          FROM c LEFT JOIN standards n ON n.kys_id = c.m WHERE NOT c.halt)""")),
    "successor_parts_prefix": (successor_parts, sql("SELECT * FROM parts WHERE base IN (SELECT split_part(is_base_id, ' (', 1) FROM standards)", _PARTS)),
    "resolve_chain": (resolve_chain, sql(
        "SELECT base, coalesce(i.kys_id, l.kys_id) AS kys_id, CASE WHEN i.kys_id IS NOT NULL THEN 'current' ELSE l.status END AS status, CASE WHEN i.kys_id IS NULL AND NOT contains(base, '(') THEN parts END AS parts, "
        "CASE WHEN i.kys_id IS NOT NULL THEN 'current' WHEN l.kys_id IS NOT NULL THEN 'withdrawn' WHEN parts IS NOT NULL AND NOT contains(base, '(') THEN 'split into parts' ELSE 'not found' END AS outcome "
        "FROM asked LEFT JOIN newest i ON i.is_base_id = base LEFT JOIN ever l ON l.is_base_id = base LEFT JOIN parts USING (base)",
        _PARTS,
        "asked AS (SELECT is_base_id AS base FROM standards UNION SELECT split_part(is_base_id, ' (', 1) FROM standards UNION SELECT 'IS ' || CAST(500 + kys_id % 7 AS VARCHAR) FROM standards)",
        "ever AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_base_id ORDER BY is_year DESC NULLS LAST, kys_id DESC) AS k FROM standards) WHERE k = 1)")),
    "edition_prune": (edition_prune, sql(
        "SELECT src, rel, kys_id, seen, 0 AS last FROM (SELECT *, row_number() OVER (PARTITION BY src, rel, b ORDER BY CASE status WHEN 'current' THEN 0 ELSE 1 END, coalesce(is_year, -1) DESC, kys_id DESC) AS n, min(kys_id) OVER (PARTITION BY src, rel, b) AS seen FROM r WHERE b IS NOT NULL) WHERE n = 1 "
        "UNION ALL SELECT src, rel, kys_id, kys_id, 1 FROM r WHERE b IS NULL",
        "r AS (SELECT e.src, e.rel, e.dst AS kys_id, CASE WHEN e.dst % 13 <> 0 THEN s.is_base_id END AS b, s.is_year, s.status FROM edges e JOIN standards s ON s.kys_id = e.dst WHERE e.rel = 'REFERENCES')")),
    "subgraph_edges": (subgraph_edges, sql("SELECT DISTINCT CASE WHEN rel IN ('REFERENCED_BY', 'REPLACES') THEN dst ELSE src END AS source, CASE WHEN rel IN ('REFERENCED_BY', 'REPLACES') THEN src ELSE dst END AS target, CASE rel WHEN 'REFERENCED_BY' THEN 'REFERENCES' WHEN 'REPLACES' THEN 'REPLACED_BY' ELSE rel END AS relationship FROM near", _NEAR)),
    "subgraph_nodes": (subgraph_nodes, sql("SELECT i.kys_id, s.title, s.status, i.kys_id IN (SELECT kys_id FROM newest) AS retrieved FROM (SELECT kys_id FROM newest UNION SELECT dst FROM near) i LEFT JOIN standards s USING (kys_id)", _NEAR)),
    "graph_card": (graph_card, sql("SELECT src, array_to_string(list_sort(list(dst) FILTER (WHERE n <= 12)), ',') AS first_refs, count(*) AS total, count(*) FILTER (WHERE status = 'withdrawn') AS withdrawn FROM (SELECT e.src, e.dst, s.status, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS n FROM edges e LEFT JOIN standards s ON s.kys_id = e.dst WHERE e.rel = 'REFERENCES' AND e.src IN (SELECT kys_id FROM newest)) GROUP BY src")),
    "pair_confirm": (pair_confirm, sql("SELECT a, b, EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a) AS confirmed FROM p", "p AS (SELECT DISTINCT x.is_base_id AS a, y.is_base_id AS b FROM edges e JOIN standards x ON x.kys_id = e.src JOIN standards y ON y.kys_id = e.dst WHERE e.rel = 'REFERENCES')")),
    "edition_counts": (edition_counts, sql("SELECT is_base_id, count(*) AS editions, count(*) FILTER (WHERE status = 'current') AS current, max(coalesce(is_year, -1)) AS newest FROM standards GROUP BY is_base_id")),
}

# the summary's SQL names successors as the chase does
PAIRS["graph_summary"] = (graph_summary, sql(
    "SELECT n.kys_id, coalesce(array_to_string(a.normative, '|'), '') AS normative, coalesce(t.nt, 0) AS normative_total, coalesce(t.rt, 0) AS references_total, coalesce(t.bt, 0) AS referenced_by_total, coalesce(array_to_string(a.replaces, '|'), '') AS replaces "
    "FROM newest n LEFT JOIN (SELECT src, count(*) FILTER (WHERE rel = 'NORMATIVELY_REFERENCES') AS nt, count(*) FILTER (WHERE rel = 'REFERENCES') AS rt, count(*) FILTER (WHERE rel = 'REFERENCED_BY') AS bt FROM both5 GROUP BY src) t ON t.src = n.kys_id "
    "LEFT JOIN (SELECT src, list(concat_ws(':', CAST(dst AS VARCHAR), is_number, status, use_instead) ORDER BY dst) FILTER (WHERE rel = 'NORMATIVELY_REFERENCES' AND k <= 12) AS normative, list(is_number ORDER BY dst) FILTER (WHERE rel = 'REPLACES' AND k <= 6) AS replaces "
    "FROM (SELECT b.*, s.is_number, s.status, u.use_instead, row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS k FROM both5 b LEFT JOIN standards s ON s.kys_id = b.dst LEFT JOIN u ON u.kys_id = b.dst) GROUP BY src) a ON a.src = n.kys_id",
    _FIVE, "chase AS (" + PAIRS["successor_recursive"][1] + ")",
    "u AS (SELECT g.kys_id, coalesce(f.is_number, x.is_number) AS use_instead FROM standards g LEFT JOIN chase c ON c.start = g.kys_id AND c.reached LEFT JOIN standards f ON f.kys_id = c.final LEFT JOIN standards x ON x.kys_id = g.replaced_by_id WHERE g.status = 'withdrawn')"))
