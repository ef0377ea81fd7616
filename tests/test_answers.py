"""The answer chain, what a search may use, references, contracts, sources and sinks."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from specweave.operators import graph, rag, relational, retrieval, search
from specweave.sources import merge, readers, writers
from specweave.streaming import events

NODES = "kys_id long, is_number string, is_base_id string, is_year int, status string, title string, aspect string, dept_code string, is_canonical boolean, replaced_by_id long, lexical_text string, mandatory_cert boolean"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        (1, "IS 10322:2014", "IS 10322", 2014, "current", "Luminaires for LED street lighting", "Product Specification", "ETD", True, None),
        (2, "IS 1:1990", "IS 1", 1990, "withdrawn", "Lamps, old", None, "ETD", True, 3),
        (3, "IS 1:2010", "IS 1", 2010, "current", "Lamps", None, "ETD", True, None),
        (4, "IS 9 (Part 1):2001", "IS 9 (Part 1)", 2001, "current", "Poles, part one", None, "CED", True, None),
        (5, "IS 9 (Part 1) (Sec 2):2001", "IS 9 (Part 1) (Sec 2)", 2001, "current", "Poles, sec two", None, "CED", True, None),
        (6, "IS 7:1960", "IS 7", 1960, "withdrawn", "Wires", None, "ETD", True, 2),
    ]
    return spark.createDataFrame([(*r, r[5], False) for r in rows], NODES)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, "REFERENCES", 2), (1, "REFERENCES", 3), (1, "REFERENCES", 4), (2, "REPLACED_BY", 3), (6, "REPLACED_BY", 2)], "src long, rel string, dst long")


def ask(spark, nodes, edges, model):
    queries = spark.createDataFrame([(1, "90W LED street light IP66"), (2, "nothing known")], "query_id long, query string")
    found = spark.createDataFrame([(1, 1, 0)], "query_id long, kys_id long, rank int")
    return {r["query_id"]: r for r in rag.run(queries, found, nodes, edges, model).collect()}


def test_answers_are_held_to_their_evidence(spark, nodes, edges):
    seen = []

    def model(prompts):
        seen.extend(prompts)
        return [json.dumps({
            "direct_recommendations": [{"standard_id": "IS 10322:2014", "reason": "covers luminaires"}, {"standard_id": "IS 42", "reason": "made up"}, {"standard_id": "IS 10322:2014", "reason": "see clause 4.2"}],
            "related_standards": [{"standard_id": "IS 1:2010", "relationship": "REFERENCES", "related_to": "IS 10322:2014"}, {"standard_id": "IS 1:2010", "relationship": "REPLACES", "related_to": "IS 10322:2014"}],
            "warnings": ["one of its own"], "confidence": "high"})] * len(prompts)

    queries = spark.createDataFrame([(1, "90W LED street light IP66"), (2, "nothing known")], "query_id long, query string")
    found = spark.createDataFrame([(1, 1, 0)], "query_id long, kys_id long, rank int")
    got = {r["query_id"]: r for r in rag.run(queries, found, nodes, edges, model).collect()}
    assert [r["standard_id"] for r in got[1]["recommendations"]] == ["IS 10322:2014"] and got[1]["confidence"] == "high"
    # the newest edition alone stands for IS 1, and its title and status come from the data
    assert [tuple(r) for r in got[1]["related"]] == [("IS 1:2010", "REFERENCES", "IS 10322:2014", "Lamps", "current")]
    assert got[1]["rejected"] == 3 and got[1]["warnings"] == ["one of its own", "3 claims were not borne out by the evidence and are left out", "not named by any evidence: 90W, IP66"]
    assert got[2]["confidence"] == "insufficient_evidence" and got[2]["warnings"] == [rag.NO_EVIDENCE] and got[2]["recommendations"] is None


def test_prompts_of_queries_without_evidence_are_never_written(spark, nodes, edges):
    broken = ask(spark, nodes, edges, lambda prompts: ["no json"] * len(prompts) if len(prompts) <= 1 and all("REQUEST\n90W" in p and "[IS 10322:2014]" in p for p in prompts) else 1 / 0)
    assert broken[1]["confidence"] == "low" and "the answer could not be read" in broken[1]["warnings"] and broken[2]["confidence"] == "insufficient_evidence"


def test_each_query_is_asked_once(spark, nodes, edges, tmp_path):
    """Whatever the plans above read, a model sees a prompt once, and all that is said of a query comes from one answer."""

    def model(prompts):
        import uuid

        for p in prompts:
            open(f"{tmp_path}/{uuid.uuid4().hex}", "w").write(p)
        mark = uuid.uuid4().hex
        return [json.dumps({"direct_recommendations": [{"standard_id": "IS 10322:2014", "reason": mark}], "related_standards": [], "warnings": [mark], "confidence": mark})] * len(prompts)

    queries = spark.createDataFrame([(i, "LED street light") for i in range(5)], "query_id long, query string")
    found = spark.createDataFrame([(i, 1, 0) for i in range(5)], "query_id long, kys_id long, rank int")
    out = rag.run(queries, found, nodes, edges, model)
    for _ in range(2):
        for r in out.collect():
            assert r["recommendations"][0]["reason"] == r["warnings"][0] == r["confidence"]
    assert len(list(tmp_path.iterdir())) == 5


def test_references_say_why_they_lead_nowhere(spark, nodes, edges):
    previews = spark.createDataFrame([(1, "ok", "IS 1; IS 9; IS 9 (Part 1/Sec 2); IS 9 (Part 1); IS 77; IS 9 (Parts 1 To 4); IS 1"), (3, "wrong_standard", "IS 1"), (4, "ok", None)], "kys_id long, scope_status string, normative_refs string")
    got = {r["cited_as"]: r for r in graph.references(previews, nodes, edges).collect()}
    assert {k: r["resolution"].split(" (")[0] for k, r in got.items()} == {
        "IS 1": "latest edition", "IS 9": "family only exists as parts", "IS 9 (Part 1/Sec 2)": "latest edition", "IS 9 (Part 1)": "latest edition", "IS 77": "no such standard in the dataset", "IS 9 (Parts 1 To 4)": "unparsed",
    }
    assert (got["IS 1"]["cited_id"], got["IS 1"]["same_dept"], got["IS 1"]["in_edges"]) == (3, 1, 1) and got["IS 9 (Part 1)"]["same_dept"] == 0
    assert {r["kys_id"]: r["use_instead"] for r in graph.use_instead(nodes).collect()} == {2: "IS 1:2010", 6: "IS 1:2010"}


def test_rings_place_each_neighbour_once(spark):
    e = spark.createDataFrame([(0, "REFERENCES", i) for i in range(1, 21)] + [(3, "REPLACED_BY", 0), (0, "REPLACED_BY", 7)], "src long, rel string, dst long")
    got = graph.ring(spark.createDataFrame([(0,)], "kys_id long"), e).orderBy("place").collect()
    assert len(got) == 12 and [(r["dst"], r["rel"]) for r in got[:3]] == [(7, "REPLACED_BY"), (3, "REPLACES"), (1, "REFERENCES")] and {r["overflow"] for r in got} == {8}


def test_search_uses_what_is_there_and_fresh(spark, nodes):
    items = spark.createDataFrame([(1, "led luminaires"), (2, "खंभे पोल बिजली sec")], "item_id long, query string")
    index = nodes.where("status = 'current'")
    scopes = spark.createDataFrame([(4, "ok", 0.9, "luminaires stand on these poles"), (1, "ok", 0.9, "streets by night"), (5, "ok", 0.9, "other words"), (3, "ok", 0.1, "luminaires luminaires")], "kys_id long, scope_status string, title_overlap double, scope_text string")
    one = lambda k: lambda q: q.select("item_id", F.lit(k).cast("long").alias("kys_id"), F.lit(0).alias("rank"))
    plain = search.retrieve(items, index, 2026)
    assert {(r["item_id"], r["kys_id"]) for r in plain.collect()} == {(1, 1), (2, 5)}
    parts = search.Parts(scopes=scopes, dense=one(3), dense_built="a", fallback=one(5), fallback_built="a")
    got = {(r["item_id"], r["kys_id"]): r["why"] for r in search.retrieve(items, index, 2026, parts, built="a").collect()}
    assert got[1, 4] == "scope text matches" and got[1, 3] == "semantically similar title" and "semantically similar title" in got[2, 5] and (2, 3) not in got
    # vectors of other texts are left out, and so are scopes of other standards
    stale = {(r["item_id"], r["kys_id"]) for r in search.retrieve(items, index, 2026, parts, built="b").collect()}
    assert (1, 3) not in stale and (1, 4) in stale
    read = search.retrieve(items, index, 2026, search.Parts(rerank=lambda q, d: [1.0 if "sec two" in x else 0.0 for x in d]))
    assert {r["item_id"]: r["kys_id"] for r in read.where("place = 1").collect()} == {1: 1, 2: 5}


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "kys_id long, title string")
    assert relational.required(df, {"kys_id": "bigint"}).count() == 2
    with pytest.raises(ValueError, match="missing"):
        relational.required(df, {"x": "string"})
    with pytest.raises(TypeError):
        relational.required(df, {"kys_id": "string"})
    with pytest.raises(Exception, match="title is null"):
        relational.required(df, {"title": "string"}).collect()
    assert relational.unchanged_shape(df, df.withColumn("title", F.lit("x"))).count() == 2
    for other in (df.limit(1), df.select("title", "kys_id")):
        with pytest.raises(ValueError):
            relational.unchanged_shape(df, other)
    assert [r["kys_id"] for r in relational.sampled(spark.range(1000).withColumnRenamed("id", "kys_id"), "kys_id", 5, 3).collect()] == [r["kys_id"] for r in relational.sampled(spark.range(1000).repartition(7).withColumnRenamed("id", "kys_id"), "kys_id", 5, 3).collect()]


def test_sources_and_sinks_of_few_lines(spark, tmp_path):
    d = str(tmp_path)
    open(f"{d}/urls.txt", "w").write("# list\n https://Example.org/A.pdf \r\n\nhttp://b\n")
    assert [(r["line"], r["name"][-4:]) for r in readers.cache_names(readers.line_list(spark, f"{d}/urls.txt")).orderBy("n").collect()] == [("https://Example.org/A.pdf", ".pdf"), ("http://b", ".pdf")]
    open(f"{d}/set.jsonl", "w").write('{"id": 1, "text": "a"}\nbroken\n\n[1]\n')
    assert readers.json_lines(spark, f"{d}/set.jsonl").count() == 1 and readers.broken_lines(spark, f"{d}/set.jsonl") == 2
    files = spark.createDataFrame([("a", b"%PDF-1.7 x"), ("b", b"<html>not here</html>"), ("c", b""), ("d", None)], "path string, content binary")
    assert [r["path"] for r in readers.pdf_cached(files).collect()] == ["a"]
    docs = spark.createDataFrame([("a", "x (cid:3) é y"), ("b", None)], "path string, text string")
    assert {r["path"]: r["text"] for r in readers.flattened_documents(docs, f"{d}/flat").collect()} == {"a": "x y", "b": ""}
    more = docs.where("path = 'a'").withColumn("text", F.lit("read anew")).union(spark.createDataFrame([("c", "new")], "path string, text string"))
    assert {r["path"]: r["text"] for r in readers.flattened_documents(more, f"{d}/flat").collect()} == {"a": "x y", "c": "new"}
    writers.vectors(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "kys_id long, embedding array<double>"), f"{d}/v")
    assert {r["kys_id"]: [round(x, 6) for x in r["vector"]] for r in readers.vectors(spark, f"{d}/v").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    assert readers.thresholds(spark, f"{d}/t", 0.95, 0.82) == (0.95, 0.82)
    writers.thresholds(spark.createDataFrame([(0.9, 0.7)], "high_min double, related_min double"), f"{d}/t")
    assert readers.thresholds(spark, f"{d}/t", 0.95, 0.82) == (0.9, 0.7)


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upserts_keep_the_newest_and_go_on_after_a_restart(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k long, at long, v string")
    table = merge.KeyedTable(spark, str(tmp_path), ["k"], "k long, at long, v string", 8)
    into = events.upsert_into(table, ["at"])
    into(frame((1, 1, "old"), (1, 3, "new"), (1, 2, "mid"), (2, 1, "x")), 4)
    into(frame((2, 9, "y"), (3, 1, "z")), 7)
    into(frame((2, 0, "again"), (3, 1, "z")), 7)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 3, "new"), (2, 9, "y"), (3, 1, "z")]
    assert sorted(tuple(r) for r in table.read(1).collect()) == [(1, 3, "new"), (2, 1, "x")]
    assert [tuple(r) for r in table.lookup(frame((3, 0, ""))).collect()] == [(3, 1, "z")]


def test_a_merge_of_few_keys_leaves_other_partitions_alone(spark, tmp_path, monkeypatch):
    rows = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("a").alias("v"))
    table = merge.KeyedTable(spark, str(tmp_path), ["k"], "k long, v string", 16)
    table.merge(rows, batch="0")
    before, few = _files(tmp_path), spark.createDataFrame([(7, "b", False), (None, "b", False), (9, "x", True)], "k long, v string, gone boolean")
    v = table.merge(few, batch="1", deleted="gone")
    assert before.items() <= _files(tmp_path).items() and 1 <= sum(f == v.folders[p] for p, f in v.folders.items() if f not in table.version(1).folders.values()) <= 3
    want = {(r["k"], r["v"]) for r in rows.collect()} - {(7, "a"), (None, "a"), (9, "a")} | {(7, "b"), (None, "b")}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == 499
    # a batch that breaks off before its manifest is not there
    monkeypatch.setattr(merge, "json", SimpleNamespace(dumps=lambda *_: 1 / 0, loads=json.loads))
    with pytest.raises(ZeroDivisionError):
        table.merge(few.withColumn("v", F.lit("c")), batch="2", deleted="gone")
    monkeypatch.undo()
    assert table.version() == v and {tuple(r) for r in table.read().collect()} == want
    assert table.vacuum() > 0 and {tuple(r) for r in table.read().collect()} == want and table.versions() == [2]
    table.merge(table.read().withColumn("gone", F.lit(True)), deleted="gone")
    assert table.read().count() == 0


def test_mined_terms(spark):
    t = spark.createDataFrame([("mild steel bars and steel pipes",)] * 3 + [("Mild STEEL of steel",)], "text string")
    got = {r["term"]: r["n"] for r in retrieval.mined_terms(t, "text", ["pipes", "unheard"], ["steel", "bars"], ["and", "of"], ["bars"], ["steel bars"], 3, alone=True).collect()}
    assert got == {"pipes": 3, "mild steel": 4, "steel": 8}
