"""Sources, sinks and contracts: whole tables are written by a sink, read back by its source, and compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frames import shared_folder
from ..functions import scoring, text
from ..operators import evaluation as E
from ..operators import rag
from ..operators import relational as R
from ..sources import readers, writers
from .tables import read, sql, standards


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sinks and their sources ------------------------------------------------------------------


def _csv(spark, d) -> str:
    at = _folder(spark, "editions")
    out = standards(spark, d).withColumn("is_number", F.concat(F.lit("Is"), F.substring("is_number", 3, 40))).withColumn("title_clean", F.concat(F.lit('a "quoted", title\nof two lines: '), F.col("title")))
    writers.csv(out.select(*[F.col(c).cast("string").alias(c) for c in out.columns]), at, readers.STANDARDS.names)
    return at


def csv_editions(spark, d):
    """Editions as CSV of strings and back with types: years, flags and ids that are not there are null."""
    s = readers.standards(spark, _csv(spark, d))
    return s.select("kys_id", "is_number", "is_base_id", "is_year", "status", "is_canonical", "mandatory_cert", "replaced_by_id", "reaffirmed_year", "aspect", "qco_status", F.md5("title_clean").alias("title_md5"))


def csv_columns(spark, d):
    """Two columns of the same file, as they are written."""
    return readers.csv_text(spark, _csv(spark, d), readers.STANDARDS, ["kys_id", "dept_code"])


def glossary_file(spark, d):
    """A glossary with comments, blanks and incomplete rows."""
    k = F.col("p_partkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("# "), F.col("p_name"))).when(k % 10 == 1, F.concat(F.lit("hin_Deva, "), F.col("p_name"), F.lit(","))).otherwise(F.concat(F.lit("hin_Deva, "), F.upper("p_name"), k.cast("string"), F.lit(" , "), F.col("p_brand")))
    at = _folder(spark, "glossary")
    head = spark.createDataFrame([(0, "lang,term,english")], "o int, value string")
    # a curated list is one small file
    head.union(read(spark, d, "part").select(F.lit(1), line)).coalesce(1).sortWithinPartitions("o").select("value").write.text(at)
    return readers.csv_with_comments(spark, at)


def records_file(spark, d):
    """Benchmark items as JSON lines without nulls, and back; broken lines between them give no row."""
    items, at = read(spark, d, "benchmark"), _folder(spark, "records")
    k = F.col("item_id")
    rows = items.select(k.cast("string").alias("id"), "text", F.when(k % 3 != 0, F.array(F.concat(F.lit("IS "), k.cast("string")))).alias("gold"), F.when(k % 2 == 0, "civil").alias("domain"), F.lit(None).cast("string").alias("note"))
    writers.json_lines(rows, at)
    lines = spark.read.text(at).union(items.select(F.when(k % 4 == 0, "").when(k % 4 == 1, "{broken").when(k % 4 == 2, "[1]").otherwise("  ")))
    lines.write.mode("overwrite").text(f"{at}-mixed")
    return readers.json_lines(spark, f"{at}-mixed").select("id", F.md5("text").alias("digest"), F.array_join("gold", "|").alias("gold"), "domain")


def fields_merged(spark, d):
    """Records with a field replaced from changes of some keys, written as a new version and read again."""
    o, at = read(spark, d, "customer"), _folder(spark, "merged")
    records = o.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    changes = records.where("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.lit("CHANGED").alias("segment"))
    writers.merged_json(records, changes, "id", at)
    return readers.json_lines(spark, at, "id long, name string, segment string")


def terms_file(spark, d):
    """Part names as a sorted list of terms and back: lower case, each once."""
    at = _folder(spark, "terms")
    writers.term_list(read(spark, d, "part").select(F.upper("p_name").alias("term")), at, "names of parts")
    return readers.gazetteer(spark, at, f"{at}-not-there")


def address_lines(spark, d):
    """Addresses of pages as a list with comments, with the names that downloads of them are kept under."""
    at = _folder(spark, "addresses")
    k = F.col("page_id")
    read(spark, d, "pages").select(F.when(k % 5 == 0, F.concat(F.lit("# "), F.col("url"))).otherwise(F.concat(F.lit("  "), F.col("url"), F.lit(" ")))).write.text(at)
    return readers.cache_names(readers.line_list(spark, at)).select(F.col("line").alias("url"), "name")


def vectors_saved(spark, d):
    """Vectors of length 1 as they are saved, by their first values and their length."""
    at = _folder(spark, "vectors")
    writers.vectors(read(spark, d, "embeddings"), at, "vec_id")
    v = readers.vectors(spark, at)
    return v.select("kys_id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("first"), F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("length"))


def flat_documents(spark, d):
    """Documents as one line of ASCII, read through a cache that holds half of them already."""
    at = _folder(spark, "flat")
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.lit(" (cid:7) end")).alias("text"))
    readers.flattened_documents(docs.where("path % 2 = 0"), at).count()
    return readers.flattened_documents(docs, at).select("path", F.md5("text").alias("digest"))


def documents_written(spark, d):
    """Parquet by partitions, overwritten once, and read with the partition's column."""
    at, docs = _folder(spark, "documents"), read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    writers.parquet(docs.withColumn("n_chars", F.lit(0)), at, ["lang"])
    writers.parquet(docs, at, ["lang"])
    return spark.read.parquet(at).where("lang <> 'de'").select("doc_id", "lang", "n_chars")


# --- contracts and checks -----------------------------------------------------------------------


def contracts_kept(spark, d):
    """Editions whose required fields are there, through a merge that keeps columns and rows."""
    s = R.required(standards(spark, d), {"kys_id": "bigint", "is_base_id": "string", "status": "string"})
    return R.unchanged_shape(s, s.withColumn("title", F.upper("title"))).select("kys_id", "is_base_id", "title")


def index_stale(spark, d):
    """Fingerprints of every source's documents before and after a change of some: which indexes would be stale."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    now = docs.withColumn("text", F.when(F.col("doc_id") % 40 == 7, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    row = lambda df: df.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws(":", "doc_id", "text"), 256))), ""), 256).alias("f"))
    return row(docs).alias("a").join(row(now).alias("b"), "source").select("source", (F.col("a.f") != F.col("b.f")).alias("stale"))


def reference_ids(spark, d):
    """Base ids of one reference of each form; ranges and other text are none."""
    k, n = F.col("kys_id"), (100 + F.col("kys_id") % 900).cast("string")
    p = (1 + k % 9).cast("string")
    forms = F.array(F.concat(F.lit("IS "), n), F.concat(F.lit("is/ISO "), n, F.lit(" : 2001")), F.concat(F.lit("IS "), n, F.lit(" (Part "), p, F.lit(")")), F.concat(F.lit("IS: "), n, F.lit(" (part "), p, F.lit(" / Sec "), p, F.lit("):1999")), F.concat(F.lit("IS "), n, F.lit(" (Parts 1 to 4)")), F.concat(F.lit("see IS "), n))
    return standards(spark, d).select("kys_id", F.posexplode(forms).alias("pos", "cited_as")).select("kys_id", "pos", text.base_id("cited_as").alias("base"))


def field_values(spark, d):
    """Values of a field that lists several."""
    v = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(" and  brandy/"), F.col("p_type"), F.lit(" ;; x"))
    return read(spark, d, "part").select("p_partkey", F.array_join(text.values_of(v), "|").alias("values"), F.array_join(text.values_of(F.lit("  ")), "|").alias("none"))


def clause_checks(spark, d):
    """Reasons that cite a clause which their title has or has not."""
    k = F.col("p_partkey")
    reason = F.concat(F.lit("meets "), F.when(k % 4 == 0, "Clause 4.2").when(k % 4 == 1, F.concat(F.lit("sec. "), F.col("p_size").cast("string"))).when(k % 4 == 2, "all clauses").otherwise("Section 7"))
    title = F.concat(F.col("p_name"), F.lit(" to clause 4.2, sec. 9 and section 7"))
    return read(spark, d, "part").select("p_partkey", text.cites_unknown_clause(reason, title).alias("unknown"))


def answers_parsed(spark, d):
    """Answers as models write them: fenced, with words round them, broken, or no JSON."""
    k, name = F.col("p_partkey"), F.col("p_name")
    body = F.concat(F.lit('{"direct_recommendations": [{"standard_id": "'), name, F.lit('", "reason": "r"}], "warnings": ["w"], "confidence": "high", "more": 1}'))
    said = F.when(k % 5 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nbye"))).when(k % 5 == 1, F.concat(F.lit("It is "), body, F.lit(" so."))).when(k % 5 == 2, F.concat(body, F.lit("}"))).when(k % 5 == 3, "nothing")
    p = rag.parse_answer(read(spark, d, "part").select("p_partkey", said.alias("answer")))
    return p.select("p_partkey", F.when(~F.col("parse_error"), F.get("parsed.direct_recommendations.standard_id", F.lit(0))).alias("standard_id"), "parse_error")


def rerank_scores(spark, d):
    """Relevances of a second reading's logits, with boosts and tiers."""
    x = (F.col("l_extendedprice") - 30_000) / 10_000
    s = scoring.sigmoid(x)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 6).alias("relevance"), scoring.tier(F.round(s, 6), 0.9, 0.6).alias("tier"))


def prompts_written(spark, d):
    """The prompts of orders, whose lines are the evidence and whose neighbouring parts are the relations: by their digests."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    evidence = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("P "), F.col("l_partkey").cast("string")).alias("is_number"), F.col("p_name").alias("title"), F.when(F.col("l_partkey") % 2 == 0, F.col("p_type")).alias("aspect"), F.col("l_linestatus").alias("status"))
    relations = lines.where("l_linenumber > 1 and l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P "), F.col("l_partkey").cast("string")).alias("s"), F.lit("REFERENCES").alias("rel"), F.concat(F.lit("P "), (F.col("l_partkey") + 1).cast("string")).alias("t"), F.col("l_linenumber").alias("n"))
    queries = read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("order of "), F.col("o_orderpriority")).alias("query"))
    p = rag.prompts(queries, rag.context(evidence, relations))
    return p.select("query_id", F.md5(F.regexp_extract("prompt", r"(?s)(REQUEST\n.*)", 1)).alias("digest"))


def item_names(spark, d):
    """Names of evaluation items by their text, and which of them are about parts of what they cite."""
    k = F.col("p_partkey")
    item = F.concat(F.col("p_name"), F.when(k % 3 == 0, " with Anodized handles").otherwise(" of steel"))
    gold = F.when(k % 2 == 0, F.array(F.lit("IS 1868"))).otherwise(F.array(F.lit("IS 1868"), F.lit("IS 456")))
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("t"), F.substring(F.md5(item), 1, 8)).alias("id"), E.is_constituent(item, gold).alias("constituent"))


_KEYS = "p_partkey % 4"
PAIRS = {
    "csv_editions": (csv_editions, sql("""SELECT kys_id, is_number, is_base_id, is_year, status, is_canonical, coalesce(mandatory_cert, false) AS mandatory_cert, replaced_by_id, reaffirmed_year, coalesce(aspect, '') AS aspect, '' AS qco_status,
md5('a "quoted", title' || chr(10) || 'of two lines: ' || title) AS title_md5 FROM standards""")),
    "csv_columns": (csv_columns, sql("SELECT CAST(kys_id AS VARCHAR) AS kys_id, dept_code FROM standards")),
    "glossary_file": (glossary_file, "SELECT 'hin_Deva' AS lang, lower(p_name) || p_partkey AS term, p_brand AS english FROM part WHERE p_partkey % 10 > 1"),
    "records_file": (records_file, "SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS digest, CASE WHEN item_id % 3 <> 0 THEN 'IS ' || item_id END AS gold, CASE WHEN item_id % 2 = 0 THEN 'civil' END AS domain FROM benchmark"),
    "fields_merged": (fields_merged, "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer"),
    "terms_file": (terms_file, "SELECT DISTINCT lower(p_name) AS term FROM part"),
    "address_lines": (address_lines, "SELECT url, substr(md5(url), 1, 10) || '.pdf' AS name FROM pages WHERE page_id % 5 <> 0"),
    "vectors_saved": (vectors_saved, "SELECT vec_id AS kys_id, round(CAST(CAST(embedding[1] / n AS FLOAT) AS DOUBLE), 4) AS first, len(embedding) AS width, 1.0::DOUBLE AS length FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n FROM embeddings)"),
    "flat_documents": (flat_documents, r"SELECT CAST(doc_id AS VARCHAR) AS path, md5(trim(regexp_replace(regexp_replace(regexp_replace(text || ' (cid:7) end', '\(cid:\d+\)', ' ', 'g'), '[^\x00-\x7f]+', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents"),
    "documents_written": (documents_written, "SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'de'"),
    "contracts_kept": (contracts_kept, sql("SELECT kys_id, is_base_id, upper(title) AS title FROM standards")),
    "index_stale": (index_stale, "SELECT source, bool_or(doc_id % 40 = 7 AND text IS NOT NULL) AS stale FROM documents GROUP BY source"),
    "reference_ids": (reference_ids, sql("SELECT kys_id, unnest(range(6)) AS pos, unnest(['IS ' || n, 'IS ' || n, 'IS ' || n || ' (Part ' || p || ')', 'IS ' || n || ' (Part ' || p || '/Sec ' || p || ')', NULL, NULL]) AS base FROM (SELECT kys_id, 100 + kys_id % 900 AS n, 1 + kys_id % 9 AS p FROM standards)")),
    "field_values": (field_values, "SELECT p_partkey, p_name || '|' || p_brand || '|brandy|' || p_type || '|x' AS values, '' AS none FROM part"),
    "clause_checks": (clause_checks, f"SELECT p_partkey, CASE {_KEYS} WHEN 1 THEN NOT contains(p_name || ' to clause 4.2, sec. 9 and section 7', 'sec. ' || p_size) ELSE false END AS unknown FROM part"),
    "answers_parsed": (answers_parsed, "SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_name END AS standard_id, p_partkey % 5 >= 2 AS parse_error FROM part"),
    "rerank_scores": (rerank_scores, "SELECT l_orderkey, l_linenumber, r AS relevance, CASE WHEN r >= 0.9 THEN 'Highly relevant' WHEN r >= 0.6 THEN 'Related' ELSE 'Possibly relevant' END AS tier FROM (SELECT *, round(1 / (1 + exp(-(l_extendedprice - 30000) / 10000)), 6) AS r FROM lineitem)"),
    "prompts_written": (prompts_written, r"""WITH l AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT l_orderkey AS q, string_agg('[P ' || l_partkey || '] ' || p_name, chr(10) ORDER BY l_linenumber, '[P ' || l_partkey || '] ' || p_name) AS e, string_agg('P ' || l_partkey || ': ' || CASE WHEN l_partkey % 2 = 0 THEN 'aspect=' || p_type || '; ' ELSE '' END || 'status=' || l_linestatus, chr(10) ORDER BY l_linenumber, 'P ' || l_partkey || ': ' || CASE WHEN l_partkey % 2 = 0 THEN 'aspect=' || p_type || '; ' ELSE '' END || 'status=' || l_linestatus) AS m FROM l GROUP BY l_orderkey),
k AS (SELECT l_orderkey AS q, string_agg('P ' || l_partkey || ' REFERENCES P ' || (l_partkey + 1), chr(10) ORDER BY l_linenumber, 'P ' || l_partkey || ' REFERENCES P ' || (l_partkey + 1)) AS k FROM l WHERE l_linenumber > 1 AND l_orderkey % 3 = 0 GROUP BY l_orderkey)
SELECT o_orderkey AS query_id, md5('REQUEST' || chr(10) || 'order of ' || o_orderpriority || chr(10) || chr(10) || 'RETRIEVED EVIDENCE' || chr(10) || e || chr(10) || chr(10) || 'METADATA' || chr(10) || m || chr(10) || chr(10) || 'KNOWLEDGE GRAPH' || chr(10) || coalesce(k, '(none)')) AS digest
FROM orders JOIN e ON e.q = o_orderkey LEFT JOIN k ON k.q = o_orderkey"""),
    "item_names": (item_names, "SELECT p_partkey, 't' || substr(md5(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' with Anodized handles' ELSE ' of steel' END), 1, 8) AS id, p_partkey % 6 = 0 AS constituent FROM part"),
}
