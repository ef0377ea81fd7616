"""Choice of editions, lookups, merges and counts, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import shared_folder
from ..functions import text
from ..functions import scoring
from ..operators import evaluation
from ..operators import relational as R
from ..sources import merge, ordered
from .tables import edges, read, sql, standards

_LIVE = "status = 'current' and is_canonical"
_COLS = ["is_base_id", "kys_id", "is_year", "status"]


def newest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(standards(spark, d).where(_LIVE), ["is_base_id"], R.by_edition())


def latest_edition(spark, d):
    return newest(spark, d).select(*_COLS)


def latest_current_first(spark, d):
    return R.latest(standards(spark, d), ["is_base_id"], R.current_first()).select(*_COLS)


def latest_unknown_year_wins(spark, d):
    return R.latest(standards(spark, d).where(_LIVE), ["is_base_id"], R.unknown_year_first()).select(*_COLS)


def anti_history(spark, d):
    return R.history(standards(spark, d), newest(spark, d)).select(*_COLS)


def semi_indexed(spark, d):
    return R.history(standards(spark, d), newest(spark, d)).join(newest(spark, d), "is_base_id", "left_semi").groupBy("is_base_id").agg(F.count(F.lit(1)).alias("n"), F.min("kys_id").alias("first_id"))


def past_vocab(spark, d):
    now = newest(spark, d).select("is_base_id", text.ascii_tokens("title").alias("now"))
    old = R.history(standards(spark, d), newest(spark, d)).join(now, "is_base_id")
    words = old.select("is_base_id", "kys_id", F.posexplode(F.array_except(text.ascii_tokens("title", text.VOCABULARY_STOPWORDS), F.col("now"))).alias("pos", "word"))
    seen = words.groupBy("is_base_id", "word").agg(F.min(F.struct("kys_id", "pos")).alias("at"))
    return seen.groupBy("is_base_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("past"))


def alias_string_agg(spark, d):
    return R.joined_text(standards(spark, d).select("dept_code", "kys_id", "title"), "dept_code", "title", "kys_id")


def left_lookup_default(spark, d):
    side = R.joined_text(standards(spark, d).where("status = 'withdrawn'"), "is_base_id", "title", "kys_id").withColumnRenamed("title", "aliases")
    return R.lookup(newest(spark, d).select("kys_id", "is_base_id"), side, "is_base_id", ["aliases"])


def metadata_merge(spark, d):
    found = read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity < 20").groupBy(F.col("l_partkey").alias("kys_id")).agg(F.max(F.year("l_shipdate")).cast("int").alias("reaffirmed_year"))
    return R.merge_metadata(standards(spark, d), found).select("kys_id", "reaffirmed_year", "change")


def metadata_merge_counts(spark, d):
    return R.value_counts(metadata_merge(spark, d), "change")


def distinct_counts(spark, d):
    return standards(spark, d).agg(F.countDistinct("is_base_id").alias("bases"), F.countDistinct("dept_code").alias("depts"), F.countDistinct("is_year").alias("years"), F.count(F.lit(1)).alias("n"))


def value_counts_share(spark, d):
    return R.value_counts(standards(spark, d), "status")


def conditional_counts(spark, d):
    e = edges(spark, d).where("rel = 'REFERENCES'").distinct()
    s = standards(spark, d)
    both = e.join(s.select(F.col("kys_id").alias("src"), F.col("dept_code").alias("sd")), "src").join(s.select(F.col("kys_id").alias("dst"), F.col("dept_code").alias("dd"), "status"), "dst")
    return both.groupBy("sd").agg(F.count_if(F.col("sd") == F.col("dd")).alias("same"), F.count_if(F.col("sd") != F.col("dd")).alias("other"), F.count_if(F.col("status") == "withdrawn").alias("withdrawn"))


def percentiles(spark, d):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.3), F.lit(0.5)))
    out = read(spark, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    return out.select("l_returnflag", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p05", "p30", "median"))), "least", "most")


def threshold_fit(spark, d):
    good = read(spark, d, "labels").withColumn("is_gold", F.col("quality") == 1).select("doc_id", "is_gold")
    return evaluation.fit_thresholds(read(spark, d, "documents").join(good, "doc_id").withColumn("score", F.col("n_chars") / 20000.0))


def tier_shares(spark, d):
    tier = scoring.tier(F.col("l_discount") * 10)
    share = lambda name: F.round(F.avg((tier == name).cast("double")), 6)
    return read(spark, d, "lineitem").agg(share("Highly relevant").alias("high"), share("Related").alias("related"), share("Possibly relevant").alias("possible"))


def cap_per_key(spark, d):
    return R.keep_first(standards(spark, d), ["dept_code"], [F.col("kys_id")], 2).select("dept_code", "kys_id")


def dedupe_first_words(spark, d):
    key = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 14), " ")
    return R.keep_first(read(spark, d, "documents").select("doc_id", key.alias("key")), ["key"], [F.col("doc_id")]).select("doc_id", "key")


def nulls_first_pick(spark, d):
    return R.latest(standards(spark, d), ["is_base_id"], [F.col("is_year").desc_nulls_last(), F.col("kys_id").desc()]).select(*_COLS)


def set_operations(spark, d):
    s = standards(spark, d)
    a, b = s.where(_LIVE).select("is_base_id"), s.where("status = 'withdrawn'").select("is_base_id")
    tag = lambda df, n: df.select("is_base_id", F.lit(n).alias("part"))
    return tag(a.union(b).distinct(), "union").union(tag(a.subtract(b), "except")).union(tag(a.intersect(b), "intersect"))


def coverage_share(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy("lang").agg(F.round(F.avg(F.lower("text").rlike("license|apache|copyright").cast("double")), 6).alias("licence"), F.round(F.avg(F.col("text").rlike("[0-9]").cast("double")), 6).alias("digits"))


def family_prefix(spark, d):
    s = newest(spark, d).select("is_base_id", F.substring_index("is_base_id", " (", 1).alias("family"))
    return s.where(text.in_family(F.col("is_base_id"), F.col("family"))).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def certified(spark, d):
    return standards(spark, d).where(F.coalesce("mandatory_cert", F.lit(False))).select("kys_id", "dept_code")


def metadata_projection(spark, d):
    m = F.map_filter(F.create_map(F.lit("aspect"), F.col("aspect"), F.lit("dept"), F.col("dept_code"), F.lit("year"), F.col("is_year").cast("string")), lambda _, v: ~text.is_missing(v))
    return standards(spark, d).select("kys_id", F.size(m).alias("n"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


def corpus_build(spark, d):
    s = newest(spark, d)
    doc = text.join_parts(text.clean_text("title"), text.clean_text("aspect"), text.clean_text("dept_code"))
    past = R.lookup(s.select("kys_id", "is_base_id", "is_number", doc.alias("doc_text")), past_vocab(spark, d), "is_base_id", ["past"])
    return past.select("kys_id", "is_base_id", "doc_text", text.join_parts(F.col("doc_text"), F.col("past"), F.col("is_number")).alias("lexical_text"))


def lookup_build(spark, d):
    return standards(spark, d).select("kys_id", "is_number", "is_base_id", "is_year", "status", "is_canonical", "replaced_by_id", text.clean_text("title").alias("title_display"))


def typed_coercion(spark, d):
    raw = read(spark, d, "events").select("event_id", F.col("props"))
    first = F.regexp_extract("props", r"(-?\d+)", 1)
    return raw.select("event_id", F.expr("try_cast(nullif(regexp_extract(props, '(-?[0-9]+)', 1), '') as bigint)").alias("number"), (F.length(first) > 0).alias("has_number"))


def fingerprint_rows(spark, d):
    """One fingerprint of all documents, by ranges of ids."""
    return R.fingerprint(read(spark, d, "documents"), "doc_id", "text")


def last_by_number(spark, d):
    return R.last_by(standards(spark, d).select("kys_id", "is_number", "status"), "is_number", "kys_id")


def smallest_prices(spark, d):
    """Parts of least price: a top-k report."""
    p = read(spark, d, "part").select("p_partkey", F.struct("p_retailprice", "p_partkey").alias("o"))
    return R.smallest(p, "o", 25).select("p_partkey")


def display_names(spark, d):
    n = text.split_number("is_number")
    title = F.concat(F.lit("Specification for "), F.col("title"), F.when(F.col("kys_id") % 3 == 0, F.lit(" - general")).otherwise(""))
    return standards(spark, d).select("kys_id", text.short_title(title, 12).alias("short"), n["base"].alias("base"), n["part"].alias("part"))


_H = "SELECT * FROM standards WHERE kys_id NOT IN (SELECT kys_id FROM newest)"
_PAST = """now AS (SELECT is_base_id, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: len(x) > 2) AS now FROM newest),
words AS (SELECT h.is_base_id, h.kys_id, unnest(range(len(w))) AS pos, unnest(w) AS word, now FROM (
  SELECT hh.is_base_id, hh.kys_id, n.now, list_filter(regexp_extract_all(lower(hh.title), '[a-z0-9]+'), lambda x: len(x) > 2 AND NOT list_contains(n.now, x) AND NOT list_contains(['and','are','but','for','from','had','has','its','not','the','that','their','them','they','this','was','were','with','within','without','into','over','under','per','etc','such','shall','may','can','all','any','other','others','part','sec','section','revision','reaffirmed','amendment','amendments','volume'], x)) AS w
  FROM (""" + _H + """) hh JOIN now n USING (is_base_id)) h),
past AS (SELECT is_base_id, string_agg(word, ' ' ORDER BY k, p, word) AS past FROM (
  SELECT is_base_id, word, min(kys_id) AS k, arg_min(pos, kys_id * 100000 + pos) AS p FROM words GROUP BY is_base_id, word) GROUP BY is_base_id)"""
_CLEAN = "trim(regexp_replace(regexp_replace({0}, '\\s[?]\\s', ' - ', 'g'), '\\s+', ' ', 'g'), ' -:;,')"
_MERGE = """found AS (SELECT l_partkey AS kys_id, max(year(l_shipdate)) AS f FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 20 GROUP BY 1),
m AS (SELECT s.kys_id, s.reaffirmed_year AS old, f, CASE WHEN f >= coalesce(is_year, 0) THEN f END AS u FROM standards s LEFT JOIN found USING (kys_id)),
merged AS (SELECT kys_id, CAST(greatest(coalesce(old, u), coalesce(u, old)) AS INTEGER) AS reaffirmed_year,
  CASE WHEN f IS NULL THEN 'not found' WHEN u IS NULL THEN 'dropped' WHEN old IS NULL THEN 'filled' WHEN u > old THEN 'raised' ELSE 'kept' END AS change FROM m)"""
_PICK = "SELECT is_base_id, kys_id, is_year, status FROM (SELECT *, row_number() OVER (PARTITION BY is_base_id ORDER BY {0}) AS k FROM standards {1}) WHERE k = 1"

def _stored_standards(spark, d):
    """Standards in natural order of their numbers, stored."""
    s = standards(spark, d).select(text.id_parts("is_number").alias("x"), "is_number", "kys_id", "title").select("x.*", "is_number", "kys_id", "title")
    keys, at = ["number", "part", "section", "is_number", "kys_id"], f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    ordered.write(s, at, keys, 200)
    return ordered.Ordered(spark, at, keys)


def sorted_index(spark, d):
    """Each standard's place in natural order, read off the stored order."""
    return _stored_standards(spark, d).placed().select("kys_id", "is_number", "place")


def sorted_lookup(spark, d):
    """Standards of the numbers that some order lines name, from the few files that hold them."""
    wanted = read(spark, d, "lineitem").where("l_linenumber = 1 and l_orderkey % 100 = 0").select((F.lit(100) + F.col("l_partkey") % 7).cast("int").alias("number"))
    return _stored_standards(spark, d).lookup(wanted).select("number", "kys_id", "title")


def merged_orders(spark, d):
    """A keyed table of orders after three batches: new rows, changed ones, and a batch that takes some away; the last is done twice."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = merge.KeyedTable(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", ["o_orderkey"], "o_orderkey long, o_orderstatus string, o_totalprice double", 16)
    table.merge(o.where("o_orderkey % 5 <> 0"), batch="new")
    late = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("L"))
    table.merge(late.union(late.withColumn("o_orderstatus", F.lit("A"))), ["o_orderstatus"], "late")
    for _ in range(2):
        table.merge(o.where("o_orderkey % 7 = 0").withColumn("gone", F.lit(True)), batch="gone", deleted="gone")
    return table.read()


_PARTS = "p AS (SELECT kys_id, is_number, title, CAST(nullif(regexp_extract(is_number, '(\\d+)', 1), '') AS INTEGER) AS number, CAST(nullif(regexp_extract(is_number, '(?i)Part\\s*(\\d+)', 1), '') AS INTEGER) AS part, CAST(nullif(regexp_extract(is_number, '(?i)Sec(?:tion)?\\s*(\\d+)', 1), '') AS INTEGER) AS section FROM standards)"
PAIRS = {
    "sorted_index": (sorted_index, sql("SELECT kys_id, is_number, row_number() OVER (ORDER BY number NULLS FIRST, part NULLS FIRST, section NULLS FIRST, is_number, kys_id) - 1 AS place FROM p", _PARTS)),
    "sorted_lookup": (sorted_lookup, sql("SELECT number, kys_id, title FROM p WHERE number IN (SELECT 100 + l_partkey % 7 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 100 = 0)", _PARTS)),
    "merged_orders": (merged_orders, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'L' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0)"),
    "latest_edition": (latest_edition, sql("SELECT is_base_id, kys_id, is_year, status FROM newest")),
    "latest_current_first": (latest_current_first, sql(_PICK.format("CASE status WHEN 'current' THEN 0 ELSE 1 END, coalesce(is_year, -1) DESC, kys_id DESC", ""))),
    "latest_unknown_year_wins": (latest_unknown_year_wins, sql(_PICK.format("is_year DESC NULLS FIRST, kys_id DESC", "WHERE status = 'current' AND is_canonical"))),
    "nulls_first_pick": (nulls_first_pick, sql(_PICK.format("is_year DESC NULLS LAST, kys_id DESC", ""))),
    "anti_history": (anti_history, sql(f"SELECT is_base_id, kys_id, is_year, status FROM ({_H})")),
    "semi_indexed": (semi_indexed, sql(f"SELECT is_base_id, count(*) AS n, min(kys_id) AS first_id FROM ({_H}) WHERE is_base_id IN (SELECT is_base_id FROM newest) GROUP BY is_base_id")),
    "past_vocab": (past_vocab, sql("SELECT * FROM past", _PAST)),
    "alias_string_agg": (alias_string_agg, sql("SELECT dept_code, string_agg(title, ' ' ORDER BY kys_id) AS title FROM standards GROUP BY dept_code")),
    "left_lookup_default": (left_lookup_default, sql("SELECT n.kys_id, n.is_base_id, coalesce(a.aliases, '') AS aliases FROM newest n LEFT JOIN (SELECT is_base_id, string_agg(title, ' ' ORDER BY kys_id) AS aliases FROM standards WHERE status = 'withdrawn' GROUP BY 1) a USING (is_base_id)")),
    "metadata_merge": (metadata_merge, sql("SELECT * FROM merged", _MERGE)),
    "metadata_merge_counts": (metadata_merge_counts, sql("SELECT change, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM merged GROUP BY change", _MERGE)),
    "distinct_counts": (distinct_counts, sql("SELECT count(DISTINCT is_base_id) AS bases, count(DISTINCT dept_code) AS depts, count(DISTINCT is_year) AS years, count(*) AS n FROM standards")),
    "value_counts_share": (value_counts_share, sql("SELECT status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM standards GROUP BY status")),
    "conditional_counts": (conditional_counts, sql("SELECT a.dept_code AS sd, count(*) FILTER (WHERE a.dept_code = b.dept_code) AS same, count(*) FILTER (WHERE a.dept_code <> b.dept_code) AS other, count(*) FILTER (WHERE b.status = 'withdrawn') AS withdrawn FROM edges e JOIN standards a ON a.kys_id = e.src JOIN standards b ON b.kys_id = e.dst WHERE rel = 'REFERENCES' GROUP BY 1")),
    "percentiles": (percentiles, "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.3), 4) AS p30, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1"),
    "threshold_fit": (threshold_fit, "WITH g AS (SELECT n_chars / 20000.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 1), p AS (SELECT round(quantile_cont(s, 0.3), 2) AS h, round(quantile_cont(s, 0.05), 2) AS l FROM g) SELECT h AS high_min, CASE WHEN l >= h THEN round(h - 0.05, 2) ELSE l END AS related_min FROM p"),
    "tier_shares": (tier_shares, "WITH s AS (SELECT l_discount * 10 AS s FROM lineitem) SELECT round(avg((s >= 0.95::DOUBLE)::INT), 6) AS high, round(avg((s >= 0.82::DOUBLE AND s < 0.95::DOUBLE)::INT), 6) AS related, round(avg((s < 0.82::DOUBLE)::INT), 6) AS possible FROM s"),
    "cap_per_key": (cap_per_key, sql("SELECT dept_code, kys_id FROM (SELECT *, row_number() OVER (PARTITION BY dept_code ORDER BY kys_id) AS k FROM standards) WHERE k <= 2")),
    "dedupe_first_words": (dedupe_first_words, "WITH k AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:14], ' ') AS key FROM documents) SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM k) WHERE n = 1"),
    "set_operations": (set_operations, sql("SELECT is_base_id, 'union' AS part FROM (SELECT is_base_id FROM a UNION SELECT is_base_id FROM b) UNION ALL SELECT is_base_id, 'except' FROM (SELECT is_base_id FROM a EXCEPT SELECT is_base_id FROM b) UNION ALL SELECT is_base_id, 'intersect' FROM (SELECT is_base_id FROM a INTERSECT SELECT is_base_id FROM b)", "a AS (SELECT is_base_id FROM standards WHERE status = 'current' AND is_canonical)", "b AS (SELECT is_base_id FROM standards WHERE status = 'withdrawn')")),
    "coverage_share": (coverage_share, "SELECT lang, round(avg(regexp_matches(lower(text), 'license|apache|copyright')::INT), 6) AS licence, round(avg(regexp_matches(text, '[0-9]')::INT), 6) AS digits FROM documents GROUP BY lang"),
    "family_prefix": (family_prefix, sql("SELECT split_part(is_base_id, ' (', 1) AS family, count(*) AS n FROM newest GROUP BY 1")),
    "certified": (certified, sql("SELECT kys_id, dept_code FROM standards WHERE coalesce(mandatory_cert, false)")),
    "metadata_projection": (metadata_projection, sql("SELECT kys_id, len(k) AS n, array_to_string(k, ',') AS keys FROM (SELECT kys_id, list_filter(['aspect', 'dept', 'year'], lambda x: CASE x WHEN 'aspect' THEN aspect IS NOT NULL WHEN 'dept' THEN dept_code IS NOT NULL ELSE is_year IS NOT NULL END) AS k FROM standards)")),
    "corpus_build": (corpus_build, sql("SELECT kys_id, is_base_id, doc_text, concat_ws(' | ', doc_text, nullif(past, ''), is_number) AS lexical_text FROM (SELECT n.kys_id, n.is_base_id, n.is_number, past, concat_ws(' | ', nullif(" + _CLEAN.format("title") + ", ''), aspect, " + _CLEAN.format("dept_code") + ") AS doc_text FROM newest n LEFT JOIN past USING (is_base_id))", _PAST)),
    "lookup_build": (lookup_build, sql("SELECT kys_id, is_number, is_base_id, is_year, status, is_canonical, replaced_by_id, " + _CLEAN.format("title") + " AS title_display FROM standards")),
    "typed_coercion": (typed_coercion, "SELECT event_id, try_cast(nullif(regexp_extract(props, '(-?[0-9]+)', 1), '') AS BIGINT) AS number, len(regexp_extract(props, '(-?[0-9]+)', 1)) > 0 AS has_number FROM events"),
    "fingerprint_rows": (fingerprint_rows, "WITH r AS (SELECT doc_id % 4096 AS cell, sha256(encode(CAST(doc_id AS VARCHAR)) || '\x00'::BLOB || encode(coalesce(text, ''))) AS h FROM documents), c AS (SELECT cell, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY cell) SELECT substr(sha256(string_agg(h, '' ORDER BY cell)), 1, 16) AS fingerprint FROM c"),
    "last_by_number": (last_by_number, sql("SELECT kys_id, is_number, status FROM (SELECT *, row_number() OVER (PARTITION BY is_number ORDER BY kys_id DESC) AS n FROM standards) WHERE n = 1")),
    "smallest_prices": (smallest_prices, "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 25"),
    "display_names": (display_names, sql("SELECT kys_id, CASE WHEN len(t) > 12 THEN rtrim(substr(t, 1, 11)) || '…' ELSE t END AS short, split_part(b, ' (', 1) AS base, substr(b, len(split_part(b, ' (', 1)) + 2) AS part FROM (SELECT kys_id, upper(substr(title, 1, 1)) || substr(title, 2) AS t, regexp_replace(is_number, ':[0-9]{4}$', '') AS b FROM standards)")),
}
