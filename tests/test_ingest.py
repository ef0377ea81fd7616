"""Fetched pages in micro-batches: statuses, resumption and an index that grows by segments."""

import pytest
from pyspark.sql import functions as F

from specweave.functions import text
from specweave.operators import lexical, retrieval
from specweave.streaming import ingest

PAGE = "<html><body><p>{}</p>" + "<p>filler of the page</p>" * 70 + "</body></html>"


@pytest.fixture()
def parts(spark, tmp_path):
    return ingest.StatusLog(spark, f"{tmp_path}/log"), lexical.Index(spark, f"{tmp_path}/index", "kys_id")


def _rows(*rows):
    return [(k, 200, "u", 200, PAGE.format(t), None) for k, t in rows]


def test_statuses(spark):
    rows = [(1, 200, "u", 200, PAGE, None), (2, 200, "u", 200, "short", None), (3, 200, "", None, None, None), (4, 503, None, None, None, None), (5, 200, "u", 404, None, None), (6, None, None, None, None, "Timeout"), (7, None, None, None, None, None)]
    got = {r["kys_id"]: r["s"] for r in spark.createDataFrame(rows, ingest.FETCHED).select("kys_id", ingest.status().alias("s")).collect()}
    assert got == {1: "ok", 2: "preview_empty", 3: "no_preview_link", 4: "search_http_503", 5: "preview_http_404", 6: "error:Timeout", 7: "search_http_none"}


def test_a_stream_of_files_grows_the_index_by_segments(spark, parts, tmp_path):
    log, index = parts
    words = spark.createDataFrame([(0, "copper tanks"), (1, "steel")], "item_id long, text string")
    put = lambda rows: spark.createDataFrame(rows, ingest.FETCHED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        stream = spark.readStream.schema(ingest.FETCHED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stream.writeStream.foreachBatch(ingest.ingest(log, index, text.tokens)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    put([*_rows((1, "copper tanks"), (2, "steel bars and steel")), (3, 503, None, None, None, None), (4, 200, "", None, None, None)])
    go()
    wanted = spark.createDataFrame([(k,) for k in range(1, 7)], "kys_id long")
    assert sorted(r[0] for r in log.open(wanted).collect()) == [3, 5, 6]
    before = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("index/segments/*/*/*.parquet")}
    put([*_rows((3, "tanks of copper and steel")), (5, None, None, None, None, "Timeout")])
    go()
    assert before.items() <= {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("index/segments/*/*/*.parquet")}.items()
    assert {r["kys_id"]: r["status"] for r in log.latest().collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "no_preview_link", 5: "error:Timeout"}
    assert log.read().count() == 6 and sorted(r[0] for r in log.open(wanted).collect()) == [5, 6]
    # ranks are those of an index of all pages at once
    pages = spark.read.schema(ingest.FETCHED).parquet(f"{tmp_path}/in").where(ingest.status() == "ok").select("kys_id", text.html_to_text("html").alias("text"))
    want = retrieval.bm25(words, pages, text.tokens("text"), text.tokens("text"), "item_id", "kys_id")
    got = index.search(words, text.tokens("text"))
    assert sorted(tuple(r) for r in got.select("item_id", "kys_id", "score", "rank").collect()) == sorted(tuple(r) for r in want.select("item_id", "kys_id", "score", "rank").collect())


def test_a_batch_done_twice_is_there_once(spark, parts):
    log, index = parts
    run = ingest.ingest(log, index, text.tokens)
    batch = spark.createDataFrame(_rows((1, "a copper tank")), ingest.FETCHED)
    run(batch, 0)
    run(batch, 0)
    run(batch.withColumn("search_code", F.lit(500)), 1)
    assert log.read().count() == 2 and index.manifest().n == 1 and len(index.manifest().segments) == 2
    assert log.latest().first()["status"] == "search_http_500"
