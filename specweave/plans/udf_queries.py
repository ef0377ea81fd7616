"""Queries of document parsers, language and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frames import cut, shared_folder
from ..functions import documents as D
from ..functions import language, notation, preview, text, translation
from ..functions import requirements as R
from ..operators import lexical, rag, segmentation
from ..streaming import events as E
from ..streaming import ingest as I
from .retrieval_queries import zipf_costs
from .tables import read
from .text_queries import PAIRS as TEXT
from .text_queries import spec_squash_cover


def line_items(spark, d):
    items = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(D.line_items(F.col("text"))).alias("pos", "item"))
    return items.select("conv_id", "turn", "pos", F.col("item.text").alias("text"), F.size("item.pairs").alias("n_pairs"))


def strip_boilerplate(spark, d):
    return read(spark, d, "documents").select("doc_id", D.query_column(F.col("text")).alias("query"))


def glued_costs(vocabulary, texts) -> dict[str, float]:
    """Costs of the words of vocabulary (word, rank) that stand anywhere in the long runs of texts (text).

    Only those travel with the plan: their number follows from the texts, that of the
    vocabulary from the corpus. Costs and the log's base count the whole vocabulary.
    """
    vocabulary = cut(vocabulary.select("word", "rank"))
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{D.LONG_RUN},}}"), F.lit(0))).alias("run")).distinct()
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    pieces = at.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(D.LONGEST_WORD), F.length("run") - F.col("at") + 1)), lambda n: F.col("run").substr(F.col("at"), n))).alias("word")).distinct()
    # the first word always goes along: no costs at all would mean no corpus
    known = vocabulary.join(pieces, "word", "left_semi").union(vocabulary.where("rank = 0"))
    return D.ranked_costs({r["word"]: r["rank"] for r in known.collect()}, vocabulary.count())


def word_split(spark, d):
    """Benchmark items with their spaces lost, split by the costs of all words of the corpus."""
    items = read(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", r"(?<=[a-z]) (?=[a-z])", ""))
    return items.select("item_id", D.query_column(F.col("text"), glued_costs(zipf_costs(spark, d), items)).alias("split"))


def unjoined_words(spark, d):
    """Neighbouring words of benchmark items without the space between them, put apart by counts over all documents."""
    model = segmentation.counted(read(spark, d, "documents"))
    glued = read(spark, d, "benchmark").select(F.explode(segmentation.glued("text")).alias("run")).where(F.char_length("run") >= segmentation.LONG).distinct()
    return segmentation.split(glued, model)


def quantities(spark, d):
    line = F.concat(F.lit("pipe "), F.col("p_size").cast("string"), F.lit(" mm to "), (F.col("p_size") + 9).cast("string"), F.lit(" mm diameter, capacity "), F.round("p_retailprice").cast("int").cast("string"), F.lit(" litres, DN "), F.col("p_size").cast("string"))
    q = read(spark, d, "part", parsed=True).select("p_partkey", F.posexplode(R.quantity_items(line)).alias("pos", "q"))
    return q.select("p_partkey", "pos", "q.value", "q.unit", "q.field", "q.value_max")


def product(spark, d):
    line = F.concat(F.lit("Supply of 20 nos "), F.col("p_name"), F.lit(" tanks for outdoor use, "), F.col("p_size").cast("string"), F.lit(" litres"))
    return read(spark, d, "part", parsed=True).select("p_partkey", R.product_column(line, ["stainless steel"]).alias("product"))


def detect_language(spark, d):
    found = language.detect("text")
    return read(spark, d, "documents").select("doc_id", "lang", found["code"].alias("code"), found["method"].alias("method"))


def detection_confidence(spark, d):
    """Language, confidence and method of every document."""
    return read(spark, d, "documents").select("doc_id", language.detection("text").alias("x")).select("doc_id", "x.code", "x.confidence", "x.method", "x.romanised")


#: Lines of one language each, with what is said of them.
LINES = (
    ("पाइप", "hin_Deva", 0.7, "script"), ("पानी के लिए टंकी और पाइप", "hin_Deva", 0.95, "script+markers"), ("पाइप आहे आणि साठी", "mar_Deva", 0.95, "script+markers"), ("पाण्याची टाकी पाहिजे", "hin_Deva", 0.6, "script"),
    ("पानीको लागि ट्याङ्की छ", "npi_Deva", 0.85, "script+markers"), ("जलं अस्ति तथा भवति", "san_Deva", 0.95, "script+markers"), ("पानि लेल टंकी अछि", "mai_Deva", 0.85, "script+markers"), ("उदक आसा आनी खातीर", "gom_Deva", 0.95, "script+markers"),
    ("दै थाखाय आरो", "brx_Deva", 0.85, "script+markers"), ("पानी गीं हैगा", "doi_Deva", 0.85, "script+markers"),
    ("পাইপ", "ben_Beng", 0.75, "script"), ("পানির জন্য এবং", "ben_Beng", 0.9, "script+markers"), ("পানীৰ বাবে", "asm_Beng", 0.9, "script+markers"), ("ঈশিং অমসুং", "mni_Beng", 0.8, "script+markers"),
    ("پانی", "urd_Arab", 0.6, "script"), ("پانی کے لیہ اور", "urd_Arab", 0.9, "script+markers"), ("پاڻي", "snd_Arab", 0.85, "script+markers"), ("آبۄ", "kas_Arab", 0.8, "script+markers"), ("لوله برای آب است", "pes_Arab", 0.85, "script+markers"), ("أنابيب من الماء في", "arb_Arab", 0.85, "script+markers"),
    ("குழாய்", "tam_Taml", 0.95, "script"), ("ಕೊಳವೆ", "kan_Knda", 0.95, "script"), ("పైపు", "tel_Telu", 0.95, "script"), ("പൈപ്പ്", "mal_Mlym", 0.95, "script"), ("પાઇપ", "guj_Gujr", 0.95, "script"), ("ਪਾਈਪ", "pan_Guru", 0.95, "script"), ("ପାଇପ", "ory_Orya", 0.95, "script"),
    ("ᱫᱟᱜ", "sat_Olck", 0.95, "script"), ("труба", "rus_Cyrl", 0.95, "script"), ("ท่อ", "tha_Thai", 0.95, "script"), ("パイプ", "jpn_Jpan", 0.95, "script"), ("파이프", "kor_Hang", 0.95, "script"), ("管道", "zho_Hans", 0.95, "script"),
    ("les tuyaux sont pour une maison", "fra_Latn", 0.55, "script+markers"), ("los tubos para una casa", "spa_Latn", 0.55, "script+markers"), ("die rohre und das dach", "deu_Latn", 0.55, "script+markers"), ("pipa yang untuk rumah ini", "ind_Latn", 0.55, "script+markers"),
    ("ong cho nha va nuoc cua", "vie_Latn", 0.55, "script+markers"), ("mabomba ya maji kwa nyumba katika mji wetu", "swh_Latn", 0.55, "script+markers"), ("tubos para uma casa com os", "por_Latn", 0.55, "script+markers"),
    ("supply of the pipes", "eng_Latn", 0.8, "script"), ("steel pipes", "eng_Latn", 0.6, "script"), ("paani ki tanki chahiye", "hin_Deva", 0.8, "romanised"), ("loha sathi dara", "mar_Deva", 0.783333, "romanised"), ("12 34", "eng_Latn", 0.3, "default"),
)


def languages_varied(spark, d):
    """Every part's name behind a line of one of many languages: few Latin letters must not outweigh a script."""
    k = F.col("p_partkey") % len(LINES)
    line = F.get(F.array(*[F.lit(t) for t, *_ in LINES]), k.cast("int"))
    return read(spark, d, "part", parsed=True).select("p_partkey", language.detection(line).alias("x")).select("p_partkey", "x.code", "x.confidence", "x.method")


def mask_unmask(spark, d):
    m = notation.masked(F.concat(F.col("p_name"), F.lit(" IP66 "), F.col("p_size").cast("string"), F.lit(" mm as per IS "), F.col("p_partkey").cast("string")))
    return read(spark, d, "part", parsed=True).select("p_partkey", m["text"].alias("masked"), F.array_join(m["kinds"], ",").alias("kinds"), F.size(m["values"]).alias("n"))


def spoken_notation(spark, d):
    return read(spark, d, "part", parsed=True).select("p_partkey", notation.spoken_text(F.concat(F.lit("eye ess seventeen eighty six pipe twenty five millimetre "), F.col("p_name"))).alias("written"))


def spec_terms(spark, d):
    t = read(spark, d, "part", parsed=True).select("p_partkey", F.posexplode(notation.spec_term_items(F.concat(F.lit("90W LED IP66 "), F.col("p_size").cast("string"), F.lit(" mm"), F.lit(" ip 66")))).alias("pos", "t"))
    return t.select("p_partkey", "pos", "t.term", "t.kind")


def pages_ingested(spark, d):
    """Pages fetched in three batches, the last of what failed before: each page's last status, how often it was tried, and whether it can be searched."""
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    log, index = I.StatusLog(spark, f"{at}/log"), lexical.Index(spark, f"{at}/index", "kys_id")
    run, k = I.ingest(log, index, text.tokens), F.col("page_id")
    fetched = lambda rows, failing: rows.select(
        k.alias("kys_id"), F.when(failing & (k % 7 == 1), 503).otherwise(200).alias("search_code"), F.when(k % 7 != 2, F.col("url")).alias("preview_url"), F.when(failing & (k % 7 == 3), 404).otherwise(200).alias("preview_code"),
        F.when(k % 7 == 4, F.substring("html", 1, 100)).otherwise(F.col("html")).alias("html"), F.when(failing & (k % 7 == 5), "Timeout").alias("error"))
    pages = read(spark, d, "pages")
    for batch in (0, 1):
        run(fetched(pages.where(k % 2 == batch), F.lit(True)), batch)
    again = log.open(pages.select(k.alias("kys_id"))).withColumnRenamed("kys_id", "page_id")
    run(fetched(pages.join(cut(again), "page_id"), k % 3 == 0), 2)
    tries = log.read().groupBy("kys_id").agg(F.count(F.lit(1)).alias("tries"))
    found = index.live().select(F.col("doc").alias("kys_id"), F.lit(True).alias("indexed"))
    return log.latest().join(tries, "kys_id").join(found, "kys_id", "left").select(F.col("kys_id").alias("page_id"), "status", "tries", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def tumbling_events(spark, d):
    return E.tumbling(E.timed(read(spark, d, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


def sliding_events(spark, d):
    return E.sliding(E.timed(read(spark, d, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


def session_events(spark, d):
    return E.sessions(E.timed(read(spark, d, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


def rollup_events(spark, d):
    return read(spark, d, "events").rollup("event_type", F.pmod("user_id", F.lit(5)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))


def language_registry(spark, d):
    return read(spark, d, "documents").select("doc_id", translation.resolve_language(F.col("lang")).alias("code"))


def glossary_match(spark, d):
    texts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("eng_Latn").alias("lang"), F.col("p_name").alias("text"))
    glossary = spark.createDataFrame([("eng_Latn", "ring", "loop"), ("eng_Latn", "widg", "gadget"), ("eng_Latn", "red widget", "crimson gadget"), ("eng_Latn", "bol", "never")], "lang string, term string, english string")
    return translation.glossary_hits(texts, glossary)


def coverage_warning(spark, d):
    return rag.coverage_warning(spec_squash_cover(spark, d))


def page_previews(spark, d):
    p = read(spark, d, "pages")
    x = preview.preview(F.col("html"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit(None).cast("string"))
    return p.select("page_id", x.alias("x")).select("page_id", "x.scope_status", "x.scope_words", "x.n_refs")


def _q(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits_sql(table: dict) -> str:
    """A list of (hits, order, code), the most first."""
    return "list_sort([" + ", ".join(f"{{'n': len(list_filter(t, lambda w: list_contains({_q(w)}, w))), 'o': {-i}, 'code': '{c}'}}" for i, (c, w) in enumerate(table.items())) + "], 'DESC')[1]"


#: Documents hold no letters beyond Latin ones but in junk: those with a tenth of others are left to languages_varied by a test.
_DETECT = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS x, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '" + language.BETWEEN.replace("'", "''") + "'), lambda w: w <> '') AS t FROM documents), "
    "h AS (SELECT doc_id, x, len(t) AS n, " + _hits_sql(language.ROMANISED) + " AS r, " + _hits_sql(language.MARKERS["Latin"]) + " AS o, len(list_filter(t, lambda w: list_contains(" + _q(language.ENGLISH_WORDS) + ", w))) AS e FROM d), "
    "k AS (SELECT *, CASE WHEN n = 0 OR NOT regexp_matches(x, '\\p{L}') THEN 'default' WHEN (r.n >= 2 OR r.n = 1 AND n <= 6) AND r.n >= e THEN 'romanised' WHEN o.n >= 2 AND o.n > e THEN 'script+markers' ELSE 'script' END AS method FROM h) "
    "SELECT doc_id, CASE method WHEN 'romanised' THEN r.code WHEN 'script+markers' THEN o.code ELSE 'eng_Latn' END AS code, "
    "round(CASE method WHEN 'default' THEN 0.3::DOUBLE WHEN 'romanised' THEN least(0.45::DOUBLE + r.n / n, 0.8::DOUBLE) WHEN 'script+markers' THEN 0.55::DOUBLE ELSE CASE WHEN e > 0 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END END, 6) AS confidence, method, method = 'romanised' AS romanised FROM k"
)
_COVER = TEXT["spec_squash_cover"][1]
_PART = "SELECT p_partkey, {0} FROM part"
PAIRS = {
    "line_items": (line_items, None),
    "strip_boilerplate": (strip_boilerplate, None),
    "word_split": (word_split, None),
    "unjoined_words": (unjoined_words, r"""WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
u AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY word),
b AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM t WHERE len(w) > 1) GROUP BY a, b),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM u),
g AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
r AS MATERIALIZED (SELECT DISTINCT run FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS run FROM g) WHERE len(run) >= 8),
p AS MATERIALIZED (SELECT run, i AS s, j AS e, word, u.n FROM (SELECT run, i, unnest(range(i + 2, least(len(run), i + 20) + 1)) AS j FROM (SELECT run, unnest(range(0, len(run) - 1)) AS i FROM r)) JOIN u ON u.word = substr(run, i + 1, j - i)),
one AS (SELECT run, e AS stop, word AS last, n AS last_n, word AS words, -ln(n / total) AS cost FROM p, tot WHERE s = 0),
two AS (SELECT o.run, p.e AS stop, p.word AS last, p.n AS last_n, o.words || ' ' || p.word AS words, cost + CASE WHEN b.n IS NULL THEN -ln(0.4::DOUBLE * p.n / total) ELSE -ln(b.n / CAST(o.last_n AS DOUBLE)) END AS cost FROM one o JOIN p ON p.run = o.run AND p.s = o.stop LEFT JOIN b ON b.a = o.last AND b.b = p.word, tot),
three AS (SELECT o.run, p.e AS stop, o.words || ' ' || p.word AS words, cost + CASE WHEN b.n IS NULL THEN -ln(0.4::DOUBLE * p.n / total) ELSE -ln(b.n / CAST(o.last_n AS DOUBLE)) END AS cost FROM two o JOIN p ON p.run = o.run AND p.s = o.stop LEFT JOIN b ON b.a = o.last AND b.b = p.word, tot),
every AS (SELECT run, words, cost, 2 AS k FROM two WHERE stop = len(run) UNION ALL SELECT run, words, cost, 3 FROM three WHERE stop = len(run) UNION ALL SELECT r.run, r.run, CASE WHEN u.n IS NULL THEN ln(total / 10) + len(r.run) * ln(10.0::DOUBLE) ELSE -ln(u.n / total) END, 1 FROM r LEFT JOIN u ON u.word = r.run, tot)
SELECT run, words, cost FROM (SELECT run, words, round(cost, 6) AS cost, row_number() OVER (PARTITION BY run ORDER BY round(cost, 6), k, words) AS x FROM every) WHERE x = 1"""),
    "quantities": (quantities, "SELECT p_partkey, 0 AS pos, p_size::DOUBLE AS value, 'mm' AS unit, 'size' AS field, p_size + 9.0::DOUBLE AS value_max FROM part UNION ALL SELECT p_partkey, 1, round(p_retailprice), 'L', 'capacity', NULL FROM part UNION ALL SELECT p_partkey, 2, p_size, 'DN', 'diameter', NULL FROM part"),
    "product": (product, "SELECT p_partkey, p_name || ' tank' AS product FROM part"),
    "detect_language": (detect_language, None),
    "detection_confidence": (detection_confidence, _DETECT),
    "languages_varied": (languages_varied, "SELECT p_partkey, x.code AS code, x.confidence AS confidence, x.method AS method FROM (SELECT p_partkey, [" + ", ".join(f"{{'code': '{c}', 'confidence': {s}::DOUBLE, 'method': '{m}'}}" for _, c, s, m in LINES) + f"][CAST(p_partkey % {len(LINES)} + 1 AS INTEGER)] AS x FROM part)"),
    "pages_ingested": (pages_ingested, "WITH p AS (SELECT page_id, page_id % 7 AS k, CASE page_id % 7 WHEN 1 THEN 'search_http_503' WHEN 3 THEN 'preview_http_404' WHEN 5 THEN 'error:Timeout' END AS failed, CASE page_id % 7 WHEN 2 THEN 'no_preview_link' WHEN 4 THEN 'preview_empty' ELSE CASE WHEN strlen(html) < 1500 THEN 'preview_empty' ELSE 'ok' END END AS good FROM pages), "
        "s AS (SELECT page_id, CASE WHEN failed IS NOT NULL AND page_id % 3 = 0 THEN failed ELSE good END AS status, CASE WHEN failed IS NULL THEN 1 ELSE 2 END AS tries FROM p) SELECT page_id, status, tries, status = 'ok' AS indexed FROM s"),
    "mask_unmask": (mask_unmask, "SELECT p_partkey, p_name || ' @1@ @2@ as per @3@' AS masked, 'code,quantity,citation' AS kinds, 3 AS n FROM part"),
    "language_registry": (language_registry, "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'es' THEN 'spa_Latn' END AS code FROM documents"),
    "glossary_match": (glossary_match, "SELECT p_partkey AS id, g.term, g.english FROM part, (VALUES ('ring', 'loop'), ('widg', 'gadget'), ('red widget', 'crimson gadget'), ('bol', 'never')) g(term, english) WHERE CASE WHEN contains(g.term, ' ') THEN contains(' ' || p_name || ' ', ' ' || g.term || ' ') ELSE list_contains(string_split(p_name, ' '), g.term) OR (len(g.term) >= 4 AND len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, g.term))) > 0) END"),
    "coverage_warning": (coverage_warning, "WITH m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, term) AS n, count(*) OVER (PARTITION BY query_id) AS k FROM (" + _COVER + ") WHERE covered_by IS NULL) SELECT query_id, 'not named by any evidence: ' || string_agg(term, ', ' ORDER BY n) FILTER (WHERE n <= 6) || CASE WHEN any_value(k) > 6 THEN ' and ' || (any_value(k) - 6) || ' more' ELSE '' END AS warning FROM m GROUP BY query_id"),
    "page_previews": (page_previews, None),
    "spoken_notation": (spoken_notation, _PART.format("'IS 1786 pipe 25 mm ' || p_name AS written")),
    "spec_terms": (spec_terms, "SELECT p_partkey, 0 AS pos, '90W' AS term, 'quantity' AS kind FROM part UNION ALL SELECT p_partkey, 1, 'IP66', 'code' FROM part UNION ALL SELECT p_partkey, 2, p_size || ' mm', 'quantity' FROM part"),
    "tumbling_events": (tumbling_events, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"),
    "sliding_events": (sliding_events, "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, (date_trunc('day', ts) - INTERVAL 1 DAY)::TIMESTAMP]) AS start FROM events) GROUP BY start"),
    "session_events": (session_events, "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"),
    "rollup_events": (rollup_events, "SELECT event_type, user_id % 5 AS bucket, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ROLLUP (event_type, user_id % 5)"),
}
