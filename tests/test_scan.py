"""BM25 by scans: equal to its SQL whatever rows and slices there are, and without the disk that pairs or texts would take."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from specweave.functions import text
from specweave.operators import scan
from specweave.plans import retrieval_queries as Q
from specweave.plans import tables

DATA = "/root/testdata/sf0.01"
STOPS = {"with": (), "without": text.INDEX_STOPWORDS}


def _files(spark):
    """Sizes of the shuffle files and of what is in the checkpoint folder, by path."""
    at = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    at.append(Q.shared_folder(spark).removeprefix("file:"))
    return {p: os.path.getsize(p) for top in at for d, _, names in os.walk(top) for n in names if os.path.exists(p := f"{d}/{n}")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_ablation_takes_little_disk_beside_its_input(spark, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", 0)  # a table of any size is read as it lies
    before = _files(spark)
    assert len(entry.queries()["bm25_ablation"](spark, DATA).collect()) == 2
    new = sum(n for p, n in _files(spark).items() if p not in before)
    assert 0 < new < 2 * os.path.getsize(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of which some share an id or have none, some no text; items that share an id or say nothing."""
    at = tmp_path_factory.mktemp("odd")
    docs = [(i, " ".join(f"w{(i * k) % 23} the" if k % 3 else f"w{i % 7} of" for k in range(1, 2 + i % 9))) for i in range(60)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, "w1 the w2"), (None, "w1 the w2"), (61, None), (62, ""), (63, "the of and"), (64, "w1 w1 w5"), (65, "w1 w1 w5"), (66, None), (66, "the w9")]
    items = [(0, "w1 the w2 w5"), (1, "W3 of w3 w21"), (2, ""), (3, None), (4, "unheard"), (5, "the of and"), (5, "w9"), (None, "w4 the w7")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return str(at), con


def _key(row):
    return tuple((v is None, v) if not isinstance(v, float) else (False, round(v, 5)) for v in row)


def test_ablation_equals_its_sql_on_odd_rows(spark, odd):
    at, con = odd
    got = entry.queries()["bm25_ablation"](spark, at).select("config", "answered", "mean_score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(entry.oracle_sql()["bm25_ablation"]).fetchall())


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_sql_in_any_slices_and_blocks(spark, odd, monkeypatch, small):
    at, con = odd
    if small:
        for name, n in (("ASKED", 4), ("TOKENS", 7), ("SCORES", 12), ("COMMON", 1)):
            monkeypatch.setattr(scan, name, n)
    words = Q.F.regexp_extract_all(Q.F.lower("text"), Q.F.lit(text.WORD), Q.F.lit(0))
    got = scan.bm25_by_stopwords(spark.read.parquet(f"{at}/benchmark.parquet"), spark.read.parquet(f"{at}/documents.parquet"), words, STOPS, top=3)
    for config, tokens in (("with", Q._ALL), ("without", Q._TOK)):
        mine = got.where(Q.F.col("config") == config).select("item_id", "doc_id", "score", "rank").collect()
        want = con.sql(f"WITH {Q._bm25(tokens, 3)} SELECT item_id, doc_id, score, rank FROM bm25").fetchall()
        assert len(want) > 9 and sorted(map(_key, mine)) == sorted(map(_key, want))


def test_nothing_to_read_or_ask(spark):
    items, docs = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([("x", "a"), ("y", "a b b"), ("z", "c")], "doc_id string, text string")
    words = Q.F.split("text", " ")
    for q, d in ((items, docs.limit(0)), (items.limit(0), docs), (items, docs.select("doc_id", Q.F.lit(None).cast("string").alias("text")))):
        assert scan.bm25_by_stopwords(q, d, words, STOPS).count() == 0
    assert {(r["config"], r["doc_id"]) for r in scan.bm25_by_stopwords(items, docs, words, STOPS).collect()} <= {("with", "y"), ("without", "y")}
