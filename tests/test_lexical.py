"""The stored index: ranks equal those of plain BM25 whatever its segments are, and blocks are skipped."""

import random

import pytest
from pyspark.sql import functions as F

from specweave.functions import text
from specweave.operators import lexical, retrieval

TOKENS = lambda: text.tokens("text")


def _corpus(spark, n, seed=1, words=300):
    rnd = random.Random(seed)
    pick = lambda k: " ".join(f"w{min(int(rnd.paretovariate(0.7)), words)}" for _ in range(k))
    rows = [(i, pick(rnd.choice([3, 8, 20, 60]))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "the of and")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "w1 w2 w3"), (1, "w7 w90 w250"), (2, "w4 w4 w4 w1"), (3, ""), (4, "unheard"), (5, None), (6, "w299 w298 w297 w200 w150")], "item_id long, text string")


def _rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "doc_id", "score", "rank").collect())


def _plain(queries, docs, top):
    return _rows(retrieval.bm25(queries, docs, TOKENS(), TOKENS(), top=top))


@pytest.mark.parametrize("top", [1, 10, 50])
def test_ranks_are_those_of_all_postings(spark, queries, tmp_path, monkeypatch, top):
    monkeypatch.setattr(lexical, "RANGE", 8)
    monkeypatch.setattr(lexical, "FEW", 0)
    docs = _corpus(spark, 900)
    index = lexical.Index(spark, str(tmp_path))
    index.add(docs, TOKENS())
    assert _rows(index.search(queries, TOKENS(), top=top)) == _plain(queries, docs, top)
    # common words have many postings below the threshold: most are never looked at
    seen = index.skipped(queries, TOKENS(), top=top)
    assert seen["read"] < seen["postings"] * (0.5 if top == 1 else 0.9 if top == 10 else 1.01)


@pytest.mark.parametrize("few", [0, 1024])
def test_a_batch_writes_its_segment_alone_and_replaces_documents(spark, queries, tmp_path, monkeypatch, few):
    monkeypatch.setattr(lexical, "FEW", few)
    docs, later = _corpus(spark, 120), _corpus(spark, 60, seed=9).withColumn("doc_id", F.col("doc_id") + 90)
    index = lexical.Index(spark, str(tmp_path))
    index.add(docs, TOKENS(), "first")
    before = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("segments/*/*/*.parquet")}
    index.add(later, TOKENS(), "second")
    after = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("segments/*/*/*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)
    every = docs.join(later, "doc_id", "left_anti").union(later)
    assert _rows(index.search(queries, TOKENS(), top=10)) == _plain(queries, every, 10)
    m = index.manifest()
    assert index.add(later, TOKENS(), "second") == m  # a batch done twice
    assert (m.version, m.n, len(m.segments)) == (2, every.count(), 2)


def test_compaction_joins_segments_of_like_size(spark, queries, tmp_path):
    index = lexical.Index(spark, str(tmp_path))
    docs = _corpus(spark, 200)
    for k in range(4):
        index.add(docs.where(F.col("doc_id") % 4 == k), TOKENS(), str(k))
    index.add(docs.where("doc_id < 9"), TOKENS(), "again")
    m = index.compact()
    assert len(m.segments) == 2 and m.version == 6
    assert _rows(index.search(queries, TOKENS(), top=10)) == _plain(queries, docs, 10)
    # the batches that were joined are still known
    m = index.compact(2)
    assert index.add(docs, TOKENS(), "2") == m
    assert _rows(index.search(queries, TOKENS(), top=10)) == _plain(queries, docs, 10)


def test_a_write_that_broke_off_is_not_seen(spark, queries, tmp_path, monkeypatch):
    index = lexical.Index(spark, str(tmp_path))
    docs = _corpus(spark, 50)
    index.add(docs, TOKENS(), "a")
    want, m = _rows(index.search(queries, TOKENS(), top=5)), index.manifest()
    monkeypatch.setattr(index, "_commit", lambda m: (_ for _ in ()).throw(OSError("broke off")))
    with pytest.raises(OSError):
        index.add(docs.withColumn("text", F.lit("w1")), TOKENS(), "b")
    monkeypatch.undo()
    assert index.manifest() == m and _rows(index.search(queries, TOKENS(), top=5)) == want


def test_empty_indexes_and_repeated_rows(spark, queries, tmp_path):
    index = lexical.Index(spark, str(tmp_path))
    assert index.search(queries, TOKENS()).count() == 0 and index.skipped(queries, TOKENS()) == {"postings": 0, "read": 0}
    docs = spark.createDataFrame([(1, "w1 w2"), (1, "w1 w2 w3"), (None, "w1"), (2, "w9")], "doc_id long, text string")
    index.add(docs.limit(0), TOKENS(), "none")
    assert index.search(queries, TOKENS()).count() == 0
    index.add(docs, TOKENS(), "some")
    assert index.manifest().n == 2 and {r["doc_id"] for r in index.search(queries, TOKENS()).collect()} <= {1, 2}


def test_staleness_is_seen_where_a_search_starts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "w1 w2")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    one = lexical.fingerprint(spark, f"{tmp_path}/docs")
    index = lexical.of_source(spark, f"{tmp_path}/index", docs, TOKENS(), one)
    assert lexical.of_source(spark, f"{tmp_path}/index", docs, TOKENS(), one).manifest().version == index.manifest().version == 1
    spark.createDataFrame([(2, "w5")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/docs")
    two = lexical.fingerprint(spark, f"{tmp_path}/docs")
    fresh = lexical.of_source(spark, f"{tmp_path}/index", spark.read.parquet(f"{tmp_path}/docs"), TOKENS(), two)
    assert one != two and fresh.manifest().version == 2 and fresh.manifest().n == 2


def test_blocks_are_made_range_by_range_in_arrow():
    import pyarrow as pa

    t = pa.array([["b", "a", "b"], ["a"], None, [], ["c", "a"]], pa.list_(pa.string()))
    rows = pa.RecordBatch.from_arrays([pa.array([7, 3, 4, 5, 9]), pa.array([3, 1, -1, 0, 2], pa.int32()), pa.array([0, 0, 0, 0, 1]), t], ["doc", "dl", "rng", "t"])
    got = sorted((r["token"], *[r[c] for c in ("rng", "docs", "tfs", "dls", "n", "max_tf", "min_dl")]) for b in lexical._blocks_of([rows]) for r in b.to_pylist())
    assert got == [("a", 0, [3, 7], [1, 1], [1, 3], 2, 1, 1), ("a", 1, [9], [1], [2], 1, 1, 2), ("b", 0, [7], [2], [3], 1, 2, 3), ("c", 1, [9], [1], [2], 1, 1, 2)]
