"""Operators on small tables: editions, graphs, evidence, sources, sinks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from specweave.operators import graph as G
from specweave.operators import rag
from specweave.operators import relational as R
from specweave.operators import retrieval
from specweave.sources import merge, readers, writers
from specweave.streaming import events as E


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def editions(spark):
    data = [(1, "IS 1", 1990, "current"), (2, "IS 1", 2000, "withdrawn"), (3, "IS 2", 1980, "withdrawn"), (4, "IS 2", 1995, "withdrawn"), (5, "IS 3 (Part 1)", None, "current"), (6, "IS 3 (Part 1)", 1970, "current"), (7, "IS 3 (Part 2)", 1971, "current")]
    return spark.createDataFrame(data, "kys_id long, is_base_id string, is_year int, status string")


def test_editions(editions):
    pick = lambda order: {r["is_base_id"]: r["kys_id"] for r in R.latest(editions, ["is_base_id"], order).collect()}
    assert pick(R.current_first()) == {"IS 1": 1, "IS 2": 4, "IS 3 (Part 1)": 6, "IS 3 (Part 2)": 7}
    assert pick(R.by_edition())["IS 1"] == 2 and pick(R.unknown_year_first())["IS 3 (Part 1)"] == 5


def test_pruning_keeps_order_and_unknown(spark, editions):
    seen = editions.select(F.lit(9).cast("long").alias("src"), F.lit("REFERENCES").alias("rel"), "kys_id", F.when(F.col("kys_id") != 4, F.col("is_base_id")).alias("is_base_id"), "is_year", "status", F.col("kys_id").alias("seq"))
    got = [r["kys_id"] for r in G.prune_editions(seen).orderBy("last", "seen").collect()]
    assert got == [1, 3, 6, 7, 4]


def test_successors_stop_at_current_cycle_and_hops(spark):
    data = [(1, 2, "withdrawn"), (2, 3, "withdrawn"), (3, None, "current"), (4, 5, "withdrawn"), (5, 4, "withdrawn"), (6, 99, "withdrawn"), *((10 + i, 11 + i, "withdrawn") for i in range(9)), (19, None, "current")]
    df = spark.createDataFrame(data, "kys_id long, replaced_by_id long, status string")
    got = {r["start"]: (r["final"], r["reached"]) for r in G.successors(df).collect()}
    assert got[1] == (3, True) and got[2] == (3, True) and not got[4][1] and got[6] == (99, False) and got[10] == (15, False) and got[14] == (19, True)


def test_resolution_and_parts(spark, editions):
    index = R.latest(editions.where("status = 'current'"), ["is_base_id"], R.by_edition())
    asked = spark.createDataFrame([("IS 1",), ("IS 2",), ("IS 3",), ("IS 9",)], "base string")
    got = {r["base"]: (r["outcome"], r["parts"]) for r in G.resolve(asked, index, editions).collect()}
    assert got == {"IS 1": ("current", None), "IS 2": ("withdrawn", None), "IS 3": ("split into parts", "IS 3 (Part 1), IS 3 (Part 2)"), "IS 9": ("not found", None)}


def test_edges(spark, editions):
    e = spark.createDataFrame([(1, "REFERENCES", 2), (1, "REFERENCES", 2), (1, "REFERENCES", 77), (None, "REFERENCES", 2), (2, "REPLACED_BY", 1)], "src long, rel string, dst long")
    kept = G.load_edges(e, editions)
    assert rows(kept) == [(1, "REFERENCES", 2), (2, "REPLACED_BY", 1)]
    assert rows(G.neighbours(editions.where("kys_id = 1"), kept)) == [(1, "REFERENCES", 2), (1, "REPLACES", 2)]
    nodes, edges = G.subgraph(G.neighbours(editions.where("kys_id = 1"), kept), editions.where("kys_id = 1"), editions.withColumn("title", F.lit("t")))
    assert rows(edges) == [(1, 2, "REFERENCES"), (2, 1, "REPLACED_BY")] and {(r["kys_id"], r["retrieved"]) for r in nodes.collect()} == {(1, True), (2, False)}


def test_merge_and_upsert(spark):
    base = spark.createDataFrame([(1, 2000, 1990), (2, None, 1990), (3, 2010, 1990), (4, 2000, 2005), (5, 1, 1)], "kys_id long, reaffirmed_year int, is_year int")
    found = spark.createDataFrame([(1, 2005), (2, 1999), (3, 2001), (4, 2004)], "kys_id long, reaffirmed_year int")
    assert {r["kys_id"]: (r["reaffirmed_year"], r["change"]) for r in R.merge_metadata(base, found).collect()} == {1: (2005, "raised"), 2: (1999, "filled"), 3: (2010, "kept"), 4: (2000, "dropped"), 5: (1, "not found")}
    new = spark.createDataFrame([(1, 7, 7), (1, 7, 7), (9, 9, 9)], base.schema)
    once = writers.upsert(base, new, ["kys_id"])
    assert rows(once) == rows(writers.upsert(once, new, ["kys_id"])) and once.count() == 6


def test_bm25_matches_the_formula(spark):
    import math

    docs = [(1, "pipe steel pipe"), (2, "steel rod"), (3, "copper wire of copper"), (4, "steel wire")]
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame([(0, "steel pipe pipe")], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), F.split("text", " "), F.split("text", " ")).collect()}
    toks = {d: t.split() for d, t in docs}
    mean = sum(map(len, toks.values())) / 4
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else eps for w, v in raw.items()}
    for d, t in toks.items():
        want = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in "steel pipe pipe".split())
        assert got.get(d, 0) == pytest.approx(max(want, 0), abs=1e-5)


def test_vectors_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 10 = 0")
    a = rows(retrieval.vector_top(q, v, top=5))
    assert a == rows(retrieval.vector_top(q, v, top=5, block_bytes=64 * 2))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {(q_, k) for q_, k, *_ in a} == {(i, int(k)) for i in range(0, 60, 10) for k in np.argsort(-(n[i] @ n.T))[:5]}


def test_fusion_and_pins(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "item_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], a.schema)
    fused = retrieval.fuse({"x": a, "y": b})
    assert [(r["doc_id"], r["sources"]) for r in fused.orderBy("rank").collect()] == [(11, "x,y"), (10, "x"), (12, "y")]
    pins = spark.createDataFrame([(1, 12, 1.0, 0)], "item_id long, doc_id long, score double, rank int")
    assert [r["doc_id"] for r in retrieval.pin(fused, pins).orderBy("place").collect()] == [12, 11, 10]


def test_answers_and_grounding(spark):
    answers = spark.createDataFrame([(1, '```json\n{"direct_recommendations": [{"standard_id": "IS 1", "reason": "r"}], "confidence": "high"}\n```'), (2, "no json"), (3, '{"direct_recommendations": "x"}'), (4, None)], "query_id long, answer string")
    got = {r["query_id"]: r for r in rag.parse_answer(answers).collect()}
    assert got[1]["parsed"]["direct_recommendations"][0]["standard_id"] == "IS 1" and not got[1]["parse_error"]
    assert got[2]["parse_error"] and got[4]["parse_error"]
    ev = spark.createDataFrame([(1, "IS 1", "Pipes (Sec 2)", 0, "pipes IP66"), (1, "IS 2", "Rods", 1, "ip-66 rods")], "query_id long, is_number string, title string, rank int, text string")
    rec = spark.createDataFrame([(1, "IS 1", "fits"), (1, "IS 9", "fits"), (1, "IS 2", "by clause 7.1")], "query_id long, standard_id string, reason string")
    assert {r["standard_id"]: r["reject_reason"] for r in rag.check_recommendations(rec, ev).collect()} == {"IS 1": None, "IS 9": "not in evidence", "IS 2": "clause not in evidence"}
    tr = spark.createDataFrame([(1, "IS 1", "REFERENCES", "IS 5")], "query_id long, s string, rel string, t string")
    claims = spark.createDataFrame([(1, "IS 5", "REFERENCES", "IS 1"), (1, "IS 1", "REPLACES", "IS 5"), (1, "IS 7", "REFERENCES", "IS 1")], tr.schema)
    assert {(r["s"], r["rel"]): r["reject_reason"] for r in rag.check_triples(claims, tr, ev).collect()} == {("IS 5", "REFERENCES"): None, ("IS 1", "REPLACES"): "relation not found", ("IS 7", "REFERENCES"): "unknown standard"}
    terms = spark.createDataFrame([(1, 0, "IP 66"), (1, 1, "90W")], "query_id long, seq int, term string")
    cov = rag.coverage(terms, ev)
    assert {r["term"]: r["covered_by"] for r in cov.collect()} == {"IP 66": "IS 1", "90W": None}
    assert rag.coverage_warning(cov).first()["warning"] == "not named by any evidence: 90W"
    ctx = rag.context(ev.withColumn("aspect", F.lit("N/A")).withColumn("status", F.lit("current")), claims.withColumn("n", F.lit(1)))
    assert "[IS 1] Pipes (Sec 2)" in ctx.first()["context"] and "aspect" not in ctx.first()["context"]
    out = rag.generate(ctx.withColumnRenamed("context", "prompt"), rag.stub_model)
    assert rag.parse_answer(out).first()["parsed"]["direct_recommendations"][0]["standard_id"] == "IS 1"


def test_every_item_has_its_evidence_among_all_documents(spark, tmp_path):
    from specweave.plans import text_queries, udf_queries

    docs = [(i, f"filler number{i} about other things") for i in range(50)] + [(90, "one two three four five six seven eight-nine")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(77, "one two three four five six seven eightnine zebra"), (78, "unheard")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query_id"], r["seq"]): r["covered_by"] for r in text_queries.spec_squash_cover(spark, str(tmp_path)).collect()}
    assert got == {(77, i): "90" for i in range(8)} | {(77, 8): None, (78, 0): None}
    warned = {r["query_id"]: r["warning"] for r in udf_queries.coverage_warning(spark, str(tmp_path)).collect()}
    assert warned == {77: "not named by any evidence: zebra", 78: "not named by any evidence: unheard"}


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "s.csv").write_text('kys_id,is_number,is_year,title_clean\n1,"Is 1:2000",2000.0,"a, ""b"""\n2,IS 2,n/a,\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("kys_id", "is_number", "is_year", "title_clean")])
    raw = readers.csv_text(spark, f"{p}/s.csv", schema)
    assert [tuple(r) for r in raw.collect()] == [("1", "Is 1:2000", "2000.0", 'a, "b"'), ("2", "IS 2", "n/a", "")]
    (tmp_path / "g.csv").write_text("lang,term,english\n# note\nhi,Sariya,rebar\nhi,,x\nta, long term ,y\n")
    assert [r["term"] for r in readers.csv_with_comments(spark, f"{p}/g.csv").collect()] == ["long term", "sariya"]
    (tmp_path / "e.jsonl").write_text('{"id": "1", "text": "t", "gold": ["IS 1"]}\n\n{"id": "2"}\n')
    assert [(r["id"], r["gold"]) for r in readers.json_lines(spark, f"{p}/e.jsonl").collect()] == [("1", ["IS 1"]), ("2", None)]
    (tmp_path / "t.txt").write_text("# c\nSteel\n steel \nBrass\n\n")
    assert rows(readers.gazetteer(spark, f"{p}/t.txt", f"{p}/missing.txt")) == [("brass",), ("steel",)]
    (tmp_path / "17.html").write_bytes("<p>é</p>".encode())
    assert rows(readers.pages(spark, f"{p}/*.html")) == [(17, "<p>é</p>")]
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, name string, n int")
    writers.json_lines(df, f"{p}/out")
    assert [json.loads(x["value"]) for x in spark.read.text(f"{p}/out").orderBy("value").collect()] == [{"k": 1, "name": "a"}, {"k": 2, "name": "b", "n": 5}]
    assert writers.merged_json(df, spark.createDataFrame([(2, 6), (3, 1)], "k long, n int"), "k", f"{p}/merged") == {"changed": 1, "missing": 1}
    writers.csv(df, f"{p}/csv", ["name", "extra"])
    assert rows(spark.read.csv(f"{p}/csv", header=True).fillna("")) == [("a", ""), ("b", "")]
    writers.term_list(df.select(F.col("name").alias("term")), f"{p}/terms", "head")
    assert [r["value"] for r in spark.read.text(f"{p}/terms").collect()] == ["# head", "a", "b"]
    assert rows(readers.not_yet_done(df.select(F.col("k").alias("kys_id")), spark.createDataFrame([(1, "ok"), (2, "error:X")], "kys_id long, status string"))) == [(2,)]
    with pytest.raises(ValueError):
        readers.one_document(spark, "  ")


def test_scanned_documents_are_refused(spark):
    df = spark.createDataFrame([("a", "x" * 100, False), ("b", "", True)], "path string, text string, scanned boolean")
    assert readers.readable(df.where("path = 'a'")).first()["text"] == "x" * 100
    with pytest.raises(Exception, match="scanned document"):
        readers.readable(df).collect()


def test_fingerprint_follows_the_text_and_not_the_partitions(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string")
    a = R.fingerprint(df, "id", "text").first()[0]
    assert a == R.fingerprint(df.repartition(7), "id", "text").first()[0] != R.fingerprint(df.where("id > 0"), "id", "text").first()[0]
    assert writers.is_stale(R.fingerprint(df, "id", "text"), R.fingerprint(df.where("id > 0"), "id", "text"), ["fingerprint"])


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    src.repartition(3).write.parquet(folder)
    batch = rows(E.tumbling(E.timed(src)))
    q = E.tumbling(E.read_stream(spark, folder)).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("t")) == batch
    table = merge.KeyedTable(spark, str(tmp_path / "up"), ["user_id"], E.EVENTS.replace("timestamp_ntz", "timestamp"), 8)
    q = E.read_stream(spark, folder).writeStream.foreachBatch(E.upsert_into(table)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert table.versions() == [1, 2, 3] and table.read().count() == src.select("user_id").distinct().count()


def test_tasks_grow_with_the_stored_bytes(spark, tmp_path):
    from specweave.frames import tasks_for

    spark.range(100_000).write.parquet(f"{tmp_path}/t")
    rows, cores = spark.read.parquet(f"{tmp_path}/t"), spark.sparkContext.defaultParallelism
    assert tasks_for(rows) == cores and tasks_for(rows, each=10_000) > 2 * cores


def test_terms_are_counted_a_few_texts_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"w": pa.array([["red", "pipe", "red", "pipe"], None, ["red"], ["pipe", "red"], []], pa.list_(pa.string()))})
    for rows in (1, 2, 1024):
        total = {}
        for b in retrieval.terms_counted(iter([batch]), rows):
            for r in b.to_pylist():
                total[r["term"], r["words"]] = total.get((r["term"], r["words"]), 0) + r["n"]
        assert total == {("red", 1): 4, ("pipe", 1): 3, ("red pipe", 2): 2, ("pipe red", 2): 2}


def test_rows_for_python_are_dealt_out(spark):
    from specweave.plans import tables

    d, cores = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    assert tables.read(spark, d, "part", parsed=True).rdd.getNumPartitions() == cores > 1
    assert tables.read(spark, d, "part").rdd.getNumPartitions() == 1


def test_edges_are_told_apart_in_tasks_of_one_size(spark, tmp_path, monkeypatch):
    """More edges, more tasks: shares of them must not grow with the input. And nothing is lost by it."""
    from specweave.frames import tasks_for
    from specweave.operators import graph as G

    n, counts = 6000, []
    nodes = spark.range(n).selectExpr("id AS kys_id", "if(id % 3 = 0, 'withdrawn', 'current') AS status")
    for times in (1, 8):
        at = f"{tmp_path}/edges{times}"
        rows = spark.range(n * times).selectExpr("id * 31 % 5999 AS src", "if(id % 2 = 0, 'REFERENCES', 'REPLACED_BY') AS rel", "id * 17 % 6007 AS dst")
        rows.union(rows).repartition(1).write.parquet(at)
        edges = spark.read.parquet(at)
        monkeypatch.setattr(G, "SHARE", 1500, raising=False)
        out = G.two_hop(G.load_edges(edges, nodes), nodes)
        counts.append((tasks_for(edges, 1500), out.rdd.getNumPartitions()))
        edges.createOrReplaceTempView("e")
        nodes.createOrReplaceTempView("n")
        d = "(SELECT DISTINCT src, rel, dst FROM e WHERE src < 6000 AND dst < 6000)"
        want = spark.sql(f"SELECT DISTINCT a.src, a.dst AS middle, b.dst FROM {d} a JOIN n ON kys_id = a.dst AND status = 'withdrawn' JOIN {d} b ON b.src = a.dst AND b.rel = 'REPLACED_BY' WHERE a.rel = 'REFERENCES'")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert counts[0][0] * 2 < counts[1][0] and all(got >= asked for asked, got in counts)


def test_words_and_pairs_are_counted_in_one_reading(spark):
    from specweave.operators import segmentation

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    texts = spark.createDataFrame([("steel pipe steel pipe",), ("pipe",), ("",), (None,), ("Bolt 3 nut",)], "text string").mapInPandas(count, "text string")
    model = segmentation.counted(texts)
    assert {tuple(r) for r in model.words.collect()} == {("steel", 2), ("pipe", 3), ("bolt", 1), ("nut", 1)} and model.total == 7
    assert {tuple(r) for r in model.pairs.collect()} == {("steel", "pipe", 2), ("pipe", "steel", 1), ("bolt", "nut", 1)}
    assert seen.value == 5
