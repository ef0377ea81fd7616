"""References, answers, gold standards and parsers over varied lines, with their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import language, notation, text
from ..functions import requirements as Q
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import rag
from ..operators import retrieval as R
from ..operators import search as S
from .graph_queries import _PARTS, loaded
from .graph_queries import PAIRS as GRAPH
from .relational_queries import newest
from .retrieval_queries import _BOOST, _OTOK, _TOK, YEAR, _bm25, _docs, _items, _overlap, index
from .tables import edges, read, sql, standards, stored_index

# --- references ----------------------------------------------------------------------------


def _previews(spark, d):
    """Pages of standards: each lists six references of every kind there is."""
    k = F.col("kys_id")
    n = lambda m: (100 + k * m % 120).cast("string")
    refs = F.concat(F.lit("IS "), n(7), F.lit("; IS "), n(3), F.lit(" (Part "), (1 + k % 4).cast("string"), F.lit("); IS "), n(11), F.lit(" (Part 2/Sec 1); IS "), n(5), F.lit(" (Parts 1 To 4); ; IS "), n(7), F.lit("; IS 99999"))
    return standards(spark, d).select("kys_id", F.when(k % 10 == 0, "wrong_standard").when(k % 10 == 1, "too_short").otherwise("ok").alias("scope_status"), F.when(k % 12 != 0, refs).alias("normative_refs"))


def normative_refs(spark, d):
    return G.references(_previews(spark, d), standards(spark, d), loaded(spark, d))


def normative_counts(spark, d):
    return normative_refs(spark, d).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kys_id").alias("pages"))


def annotate_relations(spark, d):
    rel = loaded(spark, d).where("rel = 'REPLACED_BY'").select("src", "rel", F.col("dst").alias("kys_id"), F.when(F.col("dst") % 2 == 0, F.lit("own title")).alias("title"))
    return G.annotate(rel, standards(spark, d).where("kys_id % 7 <> 0")).select("src", "kys_id", "title", "status", "is_base_id", "is_year")


def use_instead(spark, d):
    return G.use_instead(standards(spark, d))


def graph_ring(spark, d):
    return G.ring(newest(spark, d), loaded(spark, d))


def gold_chain(spark, d):
    """What items that cite a number, a part or nothing known are about."""
    s = standards(spark, d)
    cited = F.array("is_base_id", F.substring_index("is_base_id", " (", 1), F.concat(F.lit("IS "), (150 + F.col("kys_id") % 90).cast("string")))
    out = E.gold_of(s.select(F.col("kys_id").alias("doc_id"), F.lit(0).alias("pos"), F.array_distinct(cited).alias("cited")), newest(spark, d), s)
    return out.select("doc_id", F.array_join("gold", "|").alias("gold"))


def sound_scopes(spark, d):
    c = read(spark, d, "pages").withColumn("n", F.char_length("html"))
    p = c.select("page_id", F.when(F.col("n") % 3 == 0, "too_short").otherwise("ok").alias("scope_status"), (F.col("n") % 100 / 100.0).alias("title_overlap"), F.when(F.col("n") % 7 != 0, F.col("url")).alias("scope_text"))
    return S.sound_scopes(p)


# --- retrieval and answers -------------------------------------------------------------------


def scope_fusion(spark, d):
    """Three lists: whole texts by keywords and by overlap, and first lines as scopes."""
    first = _docs(spark, d).select("doc_id", F.substring_index("text", "\n", 1).alias("text"))
    words, items = text.tokens("text"), _items(spark, d)
    lists = {"keyword": index(spark, d).search(items, words), "overlap": R.keyword_overlap(items, _docs(spark, d), top=R.TOP), "scope": stored_index(spark, d, "first-lines", first, words).search(items, words)}
    return R.fuse(lists, top=10)


def items_searched(spark, d):
    """Line items that cite a standard, against the newest editions: keywords, boosts and tiers, with cited standards and parts of split ones first."""
    s = standards(spark, d)
    index_ = newest(spark, d).select("kys_id", "is_number", "is_base_id", F.concat_ws(" | ", "title", "aspect", "is_base_id").alias("lexical_text"), "aspect", "mandatory_cert", "is_year")
    items = s.where("kys_id % 40 = 7").select(F.col("kys_id").alias("item_id"), F.concat(F.col("title"), F.lit(" methods "), F.col("is_base_id")).alias("query"), F.array_distinct(F.array("is_base_id", F.substring_index("is_base_id", " (", 1))).alias("cited"))
    ranked = S.retrieve(items, index_, YEAR)
    out = S.with_pins(ranked, items, index_, s).join(ranked.select("item_id", "kys_id", "tier"), ["item_id", "kys_id"], "left")
    return out.select("item_id", "kys_id", F.round("score", 6).alias("score"), F.col("group").alias("kind"), "place", "tier")


def family_recall(spark, d):
    """Whether a document of the source that holds an item's first document by id is among the best five."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("family"))
    gold = _items(spark, d).select("item_id", (F.col("item_id") * 7).alias("doc_id")).join(docs, "doc_id")
    ranked = R.keyword_overlap(_items(spark, d), _docs(spark, d), top=10).join(docs, "doc_id")
    return R.family_recall(ranked, gold)


SEEDS, HEADS, OUT, GENERIC = ["the", "of the", "not there"], ["that", "was", "which", "nicht", "und"], ["and", "the", "of"], ["was"]


def mined_terms(spark, d):
    return R.mined_terms(_docs(spark, d), "text", SEEDS, HEADS, OUT, GENERIC, ["for that"], 25, alone=True)


def faulty_model(prompts: list[str]) -> list[str]:
    """A model that answers by the number of its first evidence: soundly, with claims no evidence bears out, with relations of which one is made up, or with broken JSON."""
    out = []
    for p in prompts:
        name = p[p.find("[") + 1 : p.find("]")]
        kind = int(name[1:]) % 4
        direct, related = [{"standard_id": name, "reason": "first in evidence"}], []
        if kind == 1:
            direct += [{"standard_id": "X1", "reason": "made up"}, {"standard_id": name, "reason": "see clause 4.2"}]
        if kind == 2:
            line = p.split("KNOWLEDGE GRAPH\n", 1)[1].split("\n")[0].split(" ")
            related = [{"standard_id": name, "relationship": "EQUALS", "related_to": name}]
            related += [{"standard_id": line[2], "relationship": line[1], "related_to": line[0]}] if len(line) == 3 else []
        said = json.dumps({"direct_recommendations": direct, "related_standards": related, "warnings": [], "confidence": "high" if kind == 0 else "low"})
        out.append(said[:-9] if kind == 3 else said)
    return out


def answers(spark, d):
    """Every benchmark item asked of all documents, by a model that makes mistakes of every kind."""
    docs = read(spark, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("kys_id"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("is_number"), F.concat(F.lit("D "), (F.col("doc_id") % 50).cast("string")).alias("is_base_id"), F.lit(2000).alias("is_year"), F.lit("current").alias("status"), F.substring("text", 1, 40).alias("title"), F.col("lang").alias("aspect"))
    top = R.keyword_overlap(_items(spark, d), _docs(spark, d), top=10).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("kys_id"), "rank")
    out = rag.run(_items(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), top, nodes, G.load_edges(edges(spark, d), nodes), faulty_model)
    n = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    return out.select("query_id", F.get("recommendations.standard_id", F.lit(0)).alias("standard_id"), n("related").alias("n_related"), "n_evidence", "rejected", "confidence")


def evidence_links(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("is_number"), F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("tag"))
    r = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P"), (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("string")).alias("standard_id"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("E"), (F.col("l_linenumber") + 1).cast("string"))).alias("evidence_tag"))
    return rag.evidence_of(r.distinct(), e)


# --- parsers over varied lines -----------------------------------------------------------------

_UNITS = (("litres", "L", "capacity"), ("mm", "mm", "size"), ("Kg", "kg", "weight"), ("watts", "W", "power"), ("sqm", "m2", "area"), ("bar", "bar", "pressure"), ("kVA", "kVA", "power"))
_BOUNDS = (("", None), ("minimum ", "minimum"), ("not exceeding ", "maximum"), ("at least ", "minimum"))
_VERBS = ("Supply of ", "Providing and fixing ", "Procurement of 5 nos ", "Laying, jointing and testing of ", "", "Erection of the ")
_TAILS = (" for outdoor use", ", class B", " conforming to IS 269", " grade 43", " as drawn")
#: Words whose beginnings look like verbs or units but are not.
_NAMES = ("Fixtures", "Forged steel flanges", "Offset printing presses", "Theodolite tripods", "Andesite slabs", "pump set", "water storage tanks", "Fittings")
_SINGULAR = ("Fixture", "Forged steel flange", "Offset printing press", "Theodolite tripod", "Andesite slab", "pump set", "water storage tank", "Fitting")
_SAID = (("eye ess seventeen eighty six", "IS 1786"), ("आई एस चार सौ छप्पन", "IS 456"), ("dee en one hundred fifty", "DN 150"), ("Fay five hundred", "Fe500"), ("twenty five millimetres", "25 mm"), ("पच्चीस litres", "25 L"), ("IS-1786", "IS 1786"), ("nothing to write", "nothing to write"))


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def quantities_varied(spark, d):
    """One quantity of each kind, bounded in each way, and what must not be read."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.concat(F.lit("as per IS 269 "), F.col("p_name"), F.lit(" of "), _pick([b[0] for b in _BOUNDS], k % 4), n, F.lit(" "), _pick([u[0] for u in _UNITS], k % 7), F.when(k % 5 == 0, F.lit(", 100 nos")).otherwise(""))
    q = read(spark, d, "part", parsed=True).select("p_partkey", F.posexplode(Q.quantity_items(line)).alias("pos", "q"))
    return q.select("p_partkey", "pos", "q.value", "q.unit", "q.field", "q.qualifier", "q.raw")


def products_varied(spark, d):
    k = F.col("p_partkey")
    line = F.concat(_pick(_VERBS, k % 6), _pick(_NAMES, k % 8), _pick(_TAILS, k % 5))
    return read(spark, d, "part", parsed=True).select("p_partkey", Q.product_column(line).alias("product"))


def requirement_pairs(spark, d):
    k = F.col("p_partkey")
    pair = lambda a, b: F.struct(F.lit(a).alias("k"), b.alias("v"))
    pairs = F.array(pair("Material", F.concat(F.col("p_brand"), F.lit(" / steel"))), pair("Capacity", F.concat(F.col("p_size").cast("string"), F.lit(" litres"))), pair("Colour", F.col("p_name")), pair("Item", F.lit("Water tanks")))
    r = Q.requirement_column(F.lit("Tank, galvanised"), pairs, {"property": ["galvanised"]})
    out = read(spark, d, "part", parsed=True).select("p_partkey", r.alias("r"))
    return out.select("p_partkey", "r.product", F.array_join("r.material", "|").alias("material"), F.array_join("r.property", "|").alias("property"), F.get("r.quantities", F.lit(0))["value"].alias("capacity"), F.array_join("r.unmapped", "|").alias("unmapped"))


def spoken_varied(spark, d):
    line = F.concat(F.col("p_name"), F.lit(" "), _pick([a for a, _ in _SAID], F.col("p_partkey") % 8), F.lit(" bars"))
    return read(spark, d, "part", parsed=True).select("p_partkey", notation.spoken_text(line).alias("written"))


def masks_restored(spark, d):
    """Masked, put into other digits and spacing, and restored: nothing may be lost."""
    line = F.concat(F.col("p_name"), F.lit(" IP66 "), F.col("p_size").cast("string"), F.lit(" mm as per IS "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" Fe500D")).otherwise(""))
    m = read(spark, d, "part", parsed=True).select("p_partkey", line.alias("line"), notation.masked(line)["text"].alias("m"))
    said = F.col("m")
    for digit, other in zip("123", "१२३", strict=True):  # of placeholders alone: digits of the prose are not theirs
        said = F.regexp_replace(said, f"(?<=@[0-9१२३]{{0,2}}){digit}(?=[0-9१२३]{{0,2}}@)", other)
    back = notation.restored(F.regexp_replace(said, "@([0-9१२३])@", "@ $1 @"), F.col("line"))
    return m.select("p_partkey", F.when(F.col("line").isNotNull(), back["text"]).alias("text"), F.size(back["missing"]).alias("missing"))


def nfc_texts(spark, d):
    """Decomposed letters and other digits beside a text."""
    t = F.concat(F.lit("é १२ Å "), F.col("text"))
    return read(spark, d, "benchmark").select("item_id", F.md5(language.normalise(t)).alias("digest"))


def heading_kinds(spark, d):
    """Lines made of part names that are headings, and lines that are not."""
    k = F.col("p_partkey")
    forms = F.array(F.concat("p_name", F.lit(":")), F.concat(F.lit("SECTION "), k.cast("string"), F.lit(" - "), F.col("p_name")), F.upper(F.translate("p_name", "0123456789", "")), F.concat("p_name", F.lit(" as per IS 456:")), F.concat(F.lit("sl no description "), F.lit("qty")), F.concat("p_name", F.lit(" supplied")))
    lines = read(spark, d, "part").select("p_partkey", F.posexplode(forms).alias("pos", "line"))
    return lines.select("p_partkey", "pos", text.is_heading("line").alias("heading"))


def _case(values, index: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({index} + 1 AS INTEGER)]"


_N = "CAST(100 + kys_id * {0} % 120 AS VARCHAR)"
_REFS = (
    "lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_base_id ORDER BY CASE status WHEN 'current' THEN 0 ELSE 1 END, coalesce(is_year, -1) DESC, kys_id DESC) AS n FROM standards WHERE is_canonical) WHERE n = 1)",
    "pv AS (SELECT *, CASE WHEN kys_id % 10 = 0 THEN 'wrong_standard' ELSE 'x' END AS st FROM standards WHERE kys_id % 12 <> 0)",
    f"rf AS (SELECT DISTINCT kys_id, is_base_id, dept_code, unnest(['IS ' || {_N.format(7)}, 'IS ' || {_N.format(3)} || ' (Part ' || (1 + kys_id % 4) || ')', 'IS ' || {_N.format(11)} || ' (Part 2/Sec 1)', 'IS ' || {_N.format(5)} || ' (Parts 1 To 4)', 'IS 99999']) AS cited_as FROM pv WHERE st <> 'wrong_standard')",
    "bs AS (SELECT *, CASE WHEN contains(cited_as, 'Parts') THEN NULL ELSE replace(cited_as, '/Sec 1)', ') (Sec 1)') END AS base FROM rf)",
    "res AS (SELECT b.kys_id, cited_as, base, l.kys_id AS cited_id, l.status AS cited_status, CASE WHEN l.kys_id IS NOT NULL THEN CAST(l.dept_code = b.dept_code AS INTEGER) END AS same_dept, "
    "CASE WHEN l.kys_id IS NOT NULL THEN CAST(EXISTS (SELECT 1 FROM edges e JOIN standards x ON x.kys_id = e.src JOIN standards y ON y.kys_id = e.dst WHERE e.rel = 'REFERENCES' AND x.is_base_id = b.is_base_id AND y.is_base_id = b.base) AS INTEGER) END AS in_edges, "
    "CASE WHEN base IS NULL THEN 'unparsed (range, list or OCR damage)' WHEN l.kys_id IS NOT NULL THEN 'latest edition' WHEN EXISTS (SELECT 1 FROM lat WHERE starts_with(lat.is_base_id, base || ' (')) THEN 'family only exists as parts' ELSE 'no such standard in the dataset' END AS resolution "
    "FROM bs b LEFT JOIN lat l ON l.is_base_id = b.base)",
)
_BOTH = "both_ways AS (SELECT src, rel, dst FROM edges UNION ALL SELECT dst, CASE rel WHEN 'REFERENCES' THEN 'REFERENCED_BY' ELSE 'REPLACES' END, src FROM edges)"
_SCOPES = _bm25(_TOK, 50, "s_").replace("FROM documents", "FROM firsts")
_HEADS = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
PAIRS = {
    "normative_refs": (normative_refs, sql("SELECT * FROM res", *_REFS)),
    "normative_counts": (normative_counts, sql("SELECT resolution, count(*) AS n, count(DISTINCT kys_id) AS pages FROM res GROUP BY resolution", *_REFS)),
    "annotate_relations": (annotate_relations, sql("SELECT e.src, e.dst AS kys_id, coalesce(CASE WHEN e.dst % 2 = 0 THEN 'own title' END, s.title) AS title, s.status, s.is_base_id, s.is_year FROM edges e LEFT JOIN (SELECT * FROM standards WHERE kys_id % 7 <> 0) s ON s.kys_id = e.dst WHERE e.rel = 'REPLACED_BY'")),
    "use_instead": (use_instead, sql("SELECT g.kys_id, coalesce(f.is_number, n.is_number) AS use_instead FROM standards g LEFT JOIN chase c ON c.start = g.kys_id AND c.reached LEFT JOIN standards f ON f.kys_id = c.final LEFT JOIN standards n ON n.kys_id = g.replaced_by_id WHERE g.status = 'withdrawn'", "chase AS (" + GRAPH["successor_recursive"][1] + ")")),
    "graph_ring": (graph_ring, sql(
        "SELECT src, dst, rel, place, overflow FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY o, dst) - 1 AS place, greatest(count(*) OVER (PARTITION BY src) - 12, 0) AS overflow FROM (SELECT src, dst, min(o) AS o, arg_min(rel, o) AS rel FROM o GROUP BY src, dst)) WHERE place < 12",
        _BOTH, "o AS (SELECT *, list_position(['REPLACED_BY', 'REPLACES', 'REFERENCES', 'REFERENCED_BY'], rel) AS o FROM both_ways WHERE src IN (SELECT kys_id FROM newest))")),
    "gold_chain": (gold_chain, sql(
        "SELECT doc_id, coalesce(array_to_string(list_distinct_in_order, '|'), '') AS gold FROM (SELECT doc_id, list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, flatten(list(coalesce(g, []) ORDER BY n)) AS g FROM (SELECT c.doc_id, c.n, "
        "CASE WHEN i.is_base_id IS NOT NULL THEN [c.base] WHEN p.parts IS NOT NULL THEN p.parts WHEN r.replacement IS NOT NULL THEN [r.replacement] END AS g FROM cites c LEFT JOIN newest i ON i.is_base_id = c.base LEFT JOIN parts p ON p.base = c.base AND NOT contains(c.base, '(') LEFT JOIN repl r ON r.base = c.base) GROUP BY doc_id))",
        "cites AS (SELECT kys_id AS doc_id, unnest(range(3)) AS n, unnest([is_base_id, split_part(is_base_id, ' (', 1), 'IS ' || CAST(150 + kys_id % 90 AS VARCHAR)]) AS base FROM standards)",
        "parts AS (SELECT split_part(is_base_id, ' (', 1) AS base, list(is_base_id ORDER BY is_base_id) AS parts FROM (SELECT DISTINCT is_base_id FROM newest WHERE contains(is_base_id, ' (')) GROUP BY 1)",
        "repl AS (SELECT m.is_base_id AS base, t.is_base_id AS replacement FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_base_id ORDER BY is_year DESC NULLS LAST, kys_id DESC) AS n FROM standards) WHERE n = 1) m JOIN standards t ON t.kys_id = m.replaced_by_id WHERE t.is_base_id IN (SELECT is_base_id FROM newest))")),
    "sound_scopes": (sound_scopes, "SELECT * FROM (SELECT page_id, CASE WHEN len(html) % 3 = 0 THEN 'too_short' ELSE 'ok' END AS scope_status, len(html) % 100 / 100.0::DOUBLE AS title_overlap, CASE WHEN len(html) % 7 <> 0 THEN url END AS scope_text FROM pages) WHERE scope_status = 'ok' AND title_overlap >= 0.35::DOUBLE AND coalesce(scope_text, '') <> ''"),
    "scope_fusion": (scope_fusion, "WITH firsts AS (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents), " + _bm25(_TOK, 50) + ", " + _SCOPES + ", " + _overlap(50) + ", u AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, 'keyword' AS src FROM bm25 UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank), 'overlap' FROM ov UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank), 'scope' FROM s_bm25), f AS (SELECT item_id, doc_id, round(sum(s), 9) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM u GROUP BY item_id, doc_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM f) WHERE rank < 10"),
    "items_searched": (items_searched, sql(
        "SELECT item_id, kys_id, round(score, 6) AS score, kind, place, tier FROM (SELECT a.*, row_number() OVER (PARTITION BY a.item_id ORDER BY kind, a.rank, a.kys_id) AS place, r.tier FROM every a LEFT JOIN rk r ON r.item_id = a.item_id AND r.kys_id = a.kys_id) WHERE place <= 10",
        "qs AS (SELECT kys_id AS item_id, title || ' methods ' || is_base_id AS text FROM standards WHERE kys_id % 40 = 7)",
        "idx AS (SELECT kys_id AS doc_id, concat_ws(' | ', title, aspect, is_base_id) AS text FROM newest)",
        _bm25(_TOK, 50).replace("FROM documents", "FROM idx").replace("FROM benchmark", "FROM qs"),
        "sc2 AS (SELECT item_id, doc_id AS kys_id, rank, greatest(0, least(1, CAST(CAST(round(1.0::DOUBLE / (60 + rank), 9) / (1.0::DOUBLE / 60) AS FLOAT) AS DOUBLE) * (1 + " + _BOOST + ") / 1.11::DOUBLE)) AS score FROM bm25 JOIN newest ON kys_id = doc_id)",
        "rk AS (SELECT *, CASE WHEN score >= 0.95 THEN 'Highly relevant' WHEN score >= 0.82 THEN 'Related' ELSE 'Possibly relevant' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, kys_id) AS p FROM sc2) WHERE p <= 10)",
        _PARTS,
        "ct AS (SELECT kys_id AS item_id, 0 AS n, is_base_id AS base FROM standards WHERE kys_id % 40 = 7 UNION SELECT kys_id, 1, split_part(is_base_id, ' (', 1) FROM standards WHERE kys_id % 40 = 7 AND contains(is_base_id, ' ('))",
        "px AS (SELECT item_id, i.kys_id, 1.0::DOUBLE AS score, n AS rank FROM ct JOIN newest i ON i.is_base_id = base UNION ALL SELECT item_id, p.kys_id, 0.95::DOUBLE, n + 1099511627776 FROM (SELECT item_id, n, unnest(string_split(parts, ', ')) AS part FROM ct JOIN parts USING (base) WHERE NOT contains(base, '(') AND base NOT IN (SELECT is_base_id FROM newest)) JOIN newest p ON p.is_base_id = part)",
        "pins AS (SELECT item_id, kys_id, max(score) AS score, min(rank) AS rank FROM px GROUP BY ALL)",
        "every AS (SELECT item_id, kys_id, score, 0 AS kind, rank FROM pins UNION ALL SELECT item_id, kys_id, score, 1, p FROM rk WHERE (item_id, kys_id) NOT IN (SELECT item_id, kys_id FROM pins))")),
    "family_recall": (family_recall, "WITH " + _overlap(10) + ", g AS (SELECT item_id, source FROM benchmark JOIN documents ON documents.doc_id = item_id * 7), h AS (SELECT g.item_id, min(CASE WHEN d.source = g.source THEN o.rank + 1 END) AS f FROM g LEFT JOIN ov o USING (item_id) LEFT JOIN documents d ON d.doc_id = o.doc_id GROUP BY g.item_id) SELECT count(*) AS n, round(avg(coalesce((f <= 5)::INT, 0)), 6) AS family_recall_5 FROM h"),
    "mined_terms": (mined_terms, "WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), t AS (SELECT NULL AS a, unnest(w) AS b FROM w UNION ALL SELECT unnest(w[1:len(w) - 1]), unnest(w[2:]) FROM w WHERE len(w) > 1), c AS (SELECT a, b, concat_ws(' ', a, b) AS term, count(*) AS n FROM t GROUP BY a, b HAVING count(*) >= 25) SELECT term, n FROM c WHERE (term IN ('the', 'of the', 'not there') OR (a IS NOT NULL AND list_contains(" + _HEADS + ", b) AND len(a) >= 3 AND a NOT IN ('and', 'the', 'of')) OR (a IS NULL AND list_contains(" + _HEADS + ", b))) AND term NOT IN ('was', 'for that')"),
    "answers": (answers, sql(
        "SELECT item_id AS query_id, CASE WHEN k <> 3 THEN 'D' || f END AS standard_id, CASE WHEN k = 2 AND near THEN 1 ELSE 0 END AS n_related, n AS n_evidence, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS rejected, CASE WHEN n = 0 THEN 'insufficient_evidence' WHEN k = 0 THEN 'high' ELSE 'low' END AS confidence FROM a",
        _overlap(10), "e AS (SELECT src, dst FROM raw_edges WHERE src IN (SELECT doc_id FROM documents) AND dst IN (SELECT doc_id FROM documents))",
        "a AS (SELECT b.item_id, min(CASE WHEN rank = 0 THEN doc_id END) AS f, min(CASE WHEN rank = 0 THEN doc_id END) % 4 AS k, count(o.doc_id) AS n, coalesce(bool_or(doc_id IN (SELECT src FROM e UNION ALL SELECT dst FROM e)), false) AS near FROM benchmark b LEFT JOIN ov o USING (item_id) GROUP BY b.item_id)")),
    "evidence_links": (evidence_links, "WITH e AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, 'P' || l_partkey AS is_number, 'E' || l_linenumber AS tag FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS query_id, 'P' || (l_partkey + l_linenumber % 2) AS standard_id, CASE WHEN l_linenumber % 3 = 0 THEN 'E' || (l_linenumber + 1) END AS evidence_tag FROM lineitem), a AS (SELECT query_id, tag, min(rank) AS rank FROM e GROUP BY ALL), b AS (SELECT query_id, is_number, min(rank) AS rank FROM e GROUP BY ALL) SELECT r.query_id, r.standard_id, r.evidence_tag, coalesce(a.rank, b.rank) AS rank FROM r LEFT JOIN a ON a.query_id = r.query_id AND a.tag = r.evidence_tag LEFT JOIN b ON b.query_id = r.query_id AND b.is_number = r.standard_id"),
    "quantities_varied": (quantities_varied, "SELECT p_partkey, 0 AS pos, p_size::DOUBLE AS value, " + _case([u[1] for u in _UNITS], "p_partkey % 7") + " AS unit, " + _case([u[2] for u in _UNITS], "p_partkey % 7") + " AS field, " + _case([b[1] for b in _BOUNDS], "p_partkey % 4") + " AS qualifier, " + _case([b[0] for b in _BOUNDS], "p_partkey % 4") + " || p_size || ' ' || " + _case([u[0] for u in _UNITS], "p_partkey % 7") + " AS raw FROM part"),
    "products_varied": (products_varied, "SELECT p_partkey, " + _case(_SINGULAR, "p_partkey % 8") + " AS product FROM part"),
    "requirement_pairs": (requirement_pairs, "SELECT p_partkey, 'Water tank' AS product, p_brand || '|steel' AS material, 'galvanised' AS property, p_size::DOUBLE AS capacity, 'Colour: ' || p_name AS unmapped FROM part"),
    "spoken_varied": (spoken_varied, "SELECT p_partkey, p_name || ' ' || " + _case([b for _, b in _SAID], "p_partkey % 8") + " || ' bars' AS written FROM part"),
    "masks_restored": (masks_restored, "SELECT p_partkey, p_name || ' IP66 ' || p_size || ' mm as per IS ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' Fe500D' ELSE '' END AS text, 0 AS missing FROM part"),
    "nfc_texts": (nfc_texts, "SELECT item_id, md5(nfc_normalize('é 12 Å ' || text)) AS digest FROM benchmark"),
    "heading_kinds": (heading_kinds, "SELECT p_partkey, unnest(range(6)) AS pos, unnest([true, true, true, false, true, false]) AS heading FROM part"),
}
