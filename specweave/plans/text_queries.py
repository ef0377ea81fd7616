"""Text, evidence and language queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, text
from ..operators import rag, retrieval
from .retrieval_queries import TOP, _overlap
from .tables import read


def _host(c: str):
    return F.regexp_extract(c, "^[a-z]+://([^/?#]+)", 1)


def html_to_text(spark, d):
    t = text.html_to_text("html")
    return read(spark, d, "pages").select("page_id", F.char_length(t).alias("n"), F.md5(t).alias("digest"))


def clean_text(spark, d):
    t = text.clean_text("text")
    return read(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"))


def tokenize_stats(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.tokens("text")).alias("n"), F.size(F.array_distinct(text.tokens("text"))).alias("distinct_n"))


def citation_extract(spark, d):
    """Citations in lines that name parts as standards."""
    line = F.concat(F.lit("as per IS "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" (Part "), F.col("p_size").cast("string"), F.lit(")"))).otherwise(""), F.lit(":2004 and is "), F.col("p_size").cast("string"), F.lit(" - 2000; "), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.array_join(text.citations(line), "|").alias("cited"), text.strip_citations(line).alias("rest"))


def title_overlap(spark, d):
    title = text.content_words(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    body = text.content_words(text.html_to_text("html"))
    return read(spark, d, "pages").select("page_id", text.title_overlap(title, body).alias("overlap"))


def script_profile(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(language.script_share("text", "Latin"), 6).alias("latin"), F.round(language.script_share("text", "Cyrillic"), 6).alias("cyrillic"), language.letters("text").alias("letters"))


def digit_fold(spark, d):
    marked = F.concat(F.lit("१२३ ٤٥٦ "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", language.fold_digits(marked).alias("folded"))


def heading_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("line").endswith(":")).alias("colons"), F.count_if(text.is_table_header("line")).alias("headers"))


def spec_squash_cover(spark, d):
    """Whether each word of benchmark items stands, squashed, in the documents that keyword overlap finds for the item among all."""
    docs, items = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("item_id", "text")
    top = retrieval.keyword_overlap(items, docs, top=TOP).select("item_id", "doc_id", "rank")
    e = docs.join(top, "doc_id").select(F.col("item_id").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("is_number"), "text")  # TOP rows an item
    q = items.select(F.col("item_id").alias("query_id"), F.posexplode(F.split("text", r"[ ]+")).alias("seq", "term"))
    return rag.coverage(q, e)


def ground_triples(spark, d):
    o = read(spark, d, "lineitem")
    triples = o.select((F.col("l_suppkey") % 10).alias("query_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("s"), F.lit("REFERENCES").alias("rel"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("t")).distinct()
    ev = o.select((F.col("l_suppkey") % 10).alias("query_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("is_number")).distinct()
    claims = o.select((F.col("l_suppkey") % 10).alias("query_id"), F.concat(F.lit("S"), (F.col("l_suppkey") + F.col("l_linenumber") % 2 * 10).cast("string")).alias("s"), F.when(F.col("l_linenumber") % 3 == 0, "REPLACES").otherwise("REFERENCES").alias("rel"), F.concat(F.lit("P"), (F.col("l_partkey") % 60).cast("string")).alias("t")).distinct()
    swapped = claims.select("query_id", F.when(F.col("s") < "S5", F.col("t")).otherwise(F.col("s")).alias("s"), "rel", F.when(F.col("s") < "S5", F.col("s")).otherwise(F.col("t")).alias("t"))
    return rag.check_triples(swapped, triples, ev).groupBy("rel", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def health_audit(spark, d):
    """Conversations as tenders, turns as items; what a turn cites follows from its text's length."""
    c = read(spark, d, "conversations").withColumn("n", F.char_length("text"))
    items = c.select(F.col("conv_id").alias("doc_id"), (F.col("n") % 3).alias("n_cited"))
    cited = c.where("n % 3 > 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("IS "), (F.col("n") % 20).cast("string"))).alias("is_number"), F.concat(F.lit("cited "), (F.col("n") % 10).cast("string")).alias("cited_as"), F.when(F.col("n") % 5 < 3, "current").when(F.col("n") % 5 == 3, "withdrawn").alias("status"))
    return rag.health(items, cited)


def context_caps(spark, d):
    rel = read(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("rel"), F.col("o_orderkey").alias("dst"))
    return rag.capped(rel, ["src", "rel"], [F.col("dst")]).select("src", "rel", "dst", "n", "left_out")


def role_turns(spark, d):
    """Wrapped lines by island: runs of turns of one length class within a conversation."""
    from pyspark.sql import Window as W

    c = read(spark, d, "conversations").select("conv_id", "turn", (F.char_length("text") > 400).alias("long"))
    w = W.partitionBy("conv_id").orderBy("turn")
    new = (F.coalesce(F.lag("long").over(w), ~F.col("long")) != F.col("long")).cast("int")
    return c.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first"))


def keyphrase_counts(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.size(text.keyphrases("text")).alias("n"), F.array_join(text.keyphrases("text"), "|").alias("phrases"))


def singular_names(spark, d):
    return read(spark, d, "part").select("p_partkey", text.singular(F.concat("p_name", F.lit("s"))).alias("name"))


def natural_order(spark, d):
    from .tables import standards

    k = text.id_parts("is_base_id")
    return standards(spark, d).select("kys_id", k["number"].alias("number"), k["part"].alias("part"))


def non_latin_route(spark, d):
    share = language.non_latin_share("text")
    return read(spark, d, "documents").groupBy("lang").agg(F.count_if(share >= 0.3).alias("fallback"), F.count(F.lit(1)).alias("n"))


_HTML = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|br|tr|li|h[1-6]|table|ul|ol|article|section|footer|nav)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM b),
h AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM c)"""
_VSTOP = "[" + ",".join(f"'{w}'" for w in text.VOCABULARY_STOPWORDS) + "]"
_WORDS4 = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]{{4,}}'), lambda x: NOT list_contains(" + _VSTOP + ", x)))"
_ORD = text.ORDINALS

PAIRS = {
    "html_to_text": (html_to_text, _HTML + " SELECT page_id, len(t) AS n, md5(t) AS digest FROM h"),
    "clean_text": (clean_text, r"SELECT doc_id, md5(CASE WHEN lower(trim(text)) IN ('', 'n/a', 'na', 'none', 'nan', '-') THEN '' ELSE trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\s[?]\s', ' - ', 'g'), 'ï¿½|[�`‘’“”]', ' ', 'g'), '(?i)\(\s*(?:" + _ORD + r")[^)]*\)', ' ', 'g'), '--', ' - '), '\s+', ' ', 'g'), ' -:;,') END) AS digest FROM documents"),
    "tokenize_stats": (tokenize_stats, r"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS distinct_n FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: NOT list_contains([" + ",".join(f"'{w}'" for w in text.INDEX_STOPWORDS) + "], x)) AS t FROM documents)"),
    "citation_extract": (citation_extract, "SELECT p_partkey, CASE WHEN a = 'IS ' || p_size THEN a ELSE a || '|IS ' || p_size END AS cited, 'as per and ; ' || p_name AS rest FROM (SELECT *, 'IS ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' (Part ' || p_size || ')' ELSE '' END AS a FROM part)"),
    "title_overlap": (title_overlap, _HTML + ", o AS (SELECT page_id, " + _WORDS4.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " AS a, " + _WORDS4.format("h.t") + " AS b FROM pages JOIN h USING (page_id)) SELECT page_id, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(a)::DOUBLE, 3) END AS overlap FROM o"),
    "script_profile": (script_profile, r"SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE len(regexp_extract_all(text, '\p{Latin}')) / n::DOUBLE END, 6) AS latin, round(CASE WHEN n = 0 THEN 0 ELSE len(regexp_extract_all(text, '\p{Cyrillic}')) / n::DOUBLE END, 6) AS cyrillic, n AS letters FROM (SELECT *, len(regexp_extract_all(text, '\p{L}')) AS n FROM documents)"),
    "digit_fold": (digit_fold, "SELECT p_partkey, '123 456 ' || p_name || ' ' || p_size AS folded FROM part"),
    "heading_lines": (heading_lines, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, line, regexp_extract_all(lower(line), '[a-z]+') AS w FROM l) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE ends_with(trim(line), ':')) AS colons, count(*) FILTER (WHERE len(w) BETWEEN 2 AND 8 AND len(list_filter(w, lambda x: NOT list_contains([" + ",".join(f"'{w}'" for w in text.HEADER_WORDS) + "], x))) = 0) AS headers FROM w GROUP BY doc_id"),
    "spec_squash_cover": (spec_squash_cover, "WITH " + _overlap(TOP) + r", q AS (SELECT item_id AS query_id, unnest(range(0, len(w))) AS seq, unnest(w) AS term FROM (SELECT item_id, regexp_split_to_array(text, '[ ]+') AS w FROM benchmark)), n AS (SELECT *, regexp_replace(lower(term), '[\s\-_/]+', '', 'g') AS needle FROM q), e AS (SELECT item_id AS query_id, rank, doc_id, regexp_replace(lower(text), '[\s\-_/]+', '', 'g') AS hay FROM ov JOIN documents USING (doc_id)), h AS (SELECT n.query_id, seq, CAST(arg_min(doc_id, rank) AS VARCHAR) AS covered_by FROM n JOIN e ON e.query_id = n.query_id AND contains(e.hay, n.needle) GROUP BY n.query_id, seq) SELECT n.query_id, n.seq, n.term, h.covered_by FROM n LEFT JOIN h USING (query_id, seq) WHERE needle <> ''"),
    "ground_triples": (ground_triples, """WITH tr AS (SELECT DISTINCT l_suppkey % 10 AS q, 'S' || l_suppkey AS s, 'REFERENCES' AS rel, 'P' || (l_partkey % 50) AS t FROM lineitem),
ids AS (SELECT q, s AS id FROM tr UNION SELECT q, t FROM tr), either AS (SELECT q, s, rel, t FROM tr UNION SELECT q, t, rel, s FROM tr),
c0 AS (SELECT DISTINCT l_suppkey % 10 AS q, 'S' || (l_suppkey + l_linenumber % 2 * 10) AS s, CASE WHEN l_linenumber % 3 = 0 THEN 'REPLACES' ELSE 'REFERENCES' END AS rel, 'P' || (l_partkey % 60) AS t FROM lineitem),
c AS (SELECT q, CASE WHEN s < 'S5' THEN t ELSE s END AS s, rel, CASE WHEN s < 'S5' THEN s ELSE t END AS t FROM c0),
o AS (SELECT c.rel, CASE WHEN a.id IS NULL THEN 'unknown standard' WHEN b.id IS NULL THEN 'unknown related' WHEN e.q IS NULL THEN 'relation not found' ELSE 'accepted' END AS outcome FROM c LEFT JOIN ids a ON a.q = c.q AND a.id = c.s LEFT JOIN ids b ON b.q = c.q AND b.id = c.t LEFT JOIN either e ON e.q = c.q AND e.s = c.s AND e.rel = c.rel AND e.t = c.t)
SELECT rel, outcome, count(*) AS n FROM o GROUP BY rel, outcome"""),
    "health_audit": (health_audit, """WITH c AS (SELECT *, len(text) AS n FROM conversations), i AS (SELECT conv_id AS doc_id, count(*) AS items, count(*) FILTER (WHERE n % 3 = 0) AS items_without FROM c GROUP BY 1),
k AS (SELECT conv_id AS doc_id, coalesce(CASE WHEN n % 2 = 0 THEN 'IS ' || (n % 20) END, 'cited ' || (n % 10)) AS key, turn, CASE WHEN n % 5 < 3 THEN 'current' WHEN n % 5 = 3 THEN 'withdrawn' END AS status FROM c WHERE n % 3 > 0),
l AS (SELECT doc_id, key, status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY turn DESC) AS r FROM k) WHERE r = 1),
p AS (SELECT doc_id, count(*) AS cited, count(*) FILTER (WHERE status = 'current') AS current FROM l GROUP BY doc_id)
SELECT doc_id, items, items_without, coalesce(cited, 0) AS cited, coalesce(current, 0) AS current, coalesce(cited, 0) - coalesce(current, 0) AS outdated FROM i LEFT JOIN p USING (doc_id)"""),
    "context_caps": (context_caps, "SELECT * FROM (SELECT o_custkey AS src, o_orderstatus AS rel, o_orderkey AS dst, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n, greatest(count(*) OVER (PARTITION BY o_custkey, o_orderstatus) - 5, 0) AS left_out FROM orders) WHERE n <= 5"),
    "turn_islands": (role_turns, "WITH c AS (SELECT conv_id, turn, len(text) > 400 AS l FROM conversations), n AS (SELECT *, CASE WHEN lag(l) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM l THEN 1 ELSE 0 END AS new FROM c), s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS turns, min(turn) AS first FROM s GROUP BY conv_id, island"),
    "keyphrases": (keyphrase_counts, r"SELECT item_id, len(p) AS n, array_to_string(p, '|') AS phrases FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\s+(?:of|for|with|and|in|to)\s+'), lambda x: trim(x)), lambda x: len(x) > 3)[1:8] AS p FROM benchmark)"),
    "singular_names": (singular_names, "SELECT p_partkey, CASE WHEN ends_with(p_name, 's') OR ends_with(p_name, 'u') OR ends_with(p_name, 'i') THEN p_name || 's' WHEN regexp_matches(lower(p_name || 's'), '(ies)$') THEN regexp_replace(p_name || 's', 'ies$', 'y') WHEN regexp_matches(lower(p_name || 's'), '(ches|shes|xes|ses)$') THEN regexp_replace(p_name || 's', 'es$', '') WHEN len(regexp_extract(p_name || 's', '(\\S*)$', 1)) > 3 THEN p_name ELSE p_name || 's' END AS name FROM part"),
    "natural_order": (natural_order, "SELECT p_partkey AS kys_id, CAST(100 + p_partkey % 97 AS INTEGER) AS number, CASE WHEN p_partkey % 4 = 1 THEN CAST(1 + p_partkey % 3 AS INTEGER) END AS part FROM part"),
    "non_latin_route": (non_latin_route, r"SELECT lang, count(*) FILTER (WHERE n > 0 AND (n - k) / n::DOUBLE >= 0.3) AS fallback, count(*) AS n FROM (SELECT lang, len(regexp_extract_all(text, '\p{L}')) AS n, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ɏªº]')) AS k FROM documents) GROUP BY lang"),
}
