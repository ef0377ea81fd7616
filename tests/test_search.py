"""Documents to answers, previews, translation and evaluation sets."""

import json

import pytest
from pyspark.sql import functions as F

from specweave import service
from specweave.functions import preview, translation
from specweave.operators import evaluation, search


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "IS 1786:2008", "IS 1786", 2008, "current", "High strength deformed steel bars | IS 1786", "Product Specification", True),
        (2, "IS 456:2000", "IS 456", 2000, "current", "Plain and reinforced concrete code of practice | IS 456", None, None),
        (3, "IS 2062 (Part 1):2011", "IS 2062 (Part 1)", 2011, "current", "Hot rolled structural steel | IS 2062 (Part 1)", "Product Specification", False),
        (4, "IS 12701:1996", "IS 12701", 1996, "current", "Rotational moulded polyethylene water storage tanks", "Product Specification", False),
        (5, "IS 999:1960", "IS 999", 1960, "withdrawn", "Old tanks", None, None),
    ]
    return spark.createDataFrame(rows, "kys_id long, is_number string, is_base_id string, is_year int, status string, lexical_text string, aspect string, mandatory_cert boolean")


@pytest.fixture(scope="module")
def engine(spark, index):
    edges = spark.createDataFrame([(1, "REFERENCES", 2)], "src long, rel string, dst long")
    return service.Engine(spark, index.where("status = 'current'"), index, edges, 2026)


def test_recommend(engine):
    out = engine.recommend("1. Deformed steel bars to IS 1786 for works\n2. Polyethylene water storage tanks of 500 litres\nGENERAL CONDITIONS\n3. Structural steel as per IS 2062 plates")
    assert len(out["items"]) == 3
    best = {}
    for c in out["candidates"]:
        best.setdefault(c["item_id"], c)
    assert [c["is_number"] for c in best.values()] == ["IS 1786:2008", "IS 12701:1996", "IS 2062 (Part 1):2011"]
    assert [c["score"] for c in best.values()][0] == 1.0 and [c["score"] for c in best.values()][2] == 0.95
    assert {(r["src"], r["rel"], r["dst"]) for r in out["related"]} >= {(1, "REFERENCES", 2)}
    assert json.loads(engine.recommend_json("polyethylene tanks"))["candidates"][0]["why"].startswith("matched polyethylene, tanks")


def test_answers_in_any_language_by_what_is_there(spark, index, tmp_path):
    from specweave.functions import text
    from specweave.operators import lexical

    now = index.where("status = 'current'")
    store = lexical.of_source(spark, f"{tmp_path}/i", now.select("kys_id", F.col("lexical_text").alias("text")), text.tokens("text"), "texts-1", "kys_id")
    edges = spark.createDataFrame([(1, "REFERENCES", 2)], "src long, rel string, dst long")
    broken = lambda prompts: 1 / 0
    first = lambda prompts: [json.dumps({"direct_recommendations": [{"standard_id": p[p.find("[") + 1 : p.find("]")], "reason": "first"}, {"standard_id": "IS 5", "reason": "made up"}], "related_standards": [], "warnings": [], "confidence": "high"}) if "tanks" in p else "" for p in prompts]
    second = lambda prompts: ["no json at all"] * len(prompts)
    translator = lambda texts, code: ["polyethylene water storage tanks" if "टंकी" in t else "" for t in texts]
    labels = spark.createDataFrame([("hin_Deva", "Related", "संबंधित"), ("tam_Taml", "Weak", "x")], "lang string, label string, text string")
    engine = service.Engine(spark, now, index.withColumn("replaced_by_id", F.lit(None).cast("long")), edges, 2026, search.Parts(keyword=store), "texts-1", (broken, first, second), translator, labels)
    out = engine.answer("पानी की टंकी के लिए\nDeformed steel bars to IS 1786 for works")
    assert out["language"] == {"code": "hin_Deva", "confidence": 0.95} and out["labels"] == {"Related": "संबंधित", "Weak": "Weak"}
    tank, bars = out["answers"]
    assert [r["standard_id"] for r in tank["recommendations"]] == ["IS 12701:1996"] and tank["rejected"] == 1 and tank["confidence"] == "high" and tank["asked"].startswith("polyethylene")
    # the second model was asked for what the first left open; what it said could not be read
    assert bars["recommendations"] is None and "the answer could not be read" in bars["warnings"] and bars["n_evidence"] >= 1
    assert engine.answer("water tanks", language="ta")["language"] == {"code": "tam_Taml", "confidence": 1.0}
    assert engine.status() == {"standards": 4, "stored_index": True, "scopes": False, "semantic": False, "rerank": False, "models": 3, "translator": True}
    stale = service.Engine(spark, now, index, edges, 2026, search.Parts(keyword=store), "texts-2")
    assert not stale.status()["stored_index"] and stale.recommend("polyethylene tanks")["candidates"][0]["is_number"] == "IS 12701:1996"
    assert {x["code"] for x in engine.languages()} >= {"hin_Deva", "urd_Arab"}


def test_parts_stand_behind_all_exact_citations(spark, index):
    many = [f"IS {k}" for k in range(3000, 4100)]
    items = spark.createDataFrame([(1, ["IS 2062", *many, "IS 1786"])], "item_id long, cited array<string>")
    none = spark.createDataFrame([], "item_id long, kys_id long, score double, place int")
    got = search.with_pins(none, items, index.where("status = 'current'"), index.withColumn("replaced_by_id", F.lit(None).cast("long"))).orderBy("place").collect()
    assert [r["kys_id"] for r in got] == [1, 3]


def test_health(engine):
    assert engine.health("Steel bars to IS 1786 here\nTanks to IS 999 please\nPlain wooden doors") == {"doc_id": 0, "items": 3, "items_without": 1, "cited": 2, "current": 1, "outdated": 1}


def test_requests_are_checked(engine):
    for name, content, status in (("a.doc", b"x", 400), ("a.txt", b" ", 422), ("a.pdf", b"x" * (service.MAX_UPLOAD + 1), 413)):
        with pytest.raises(service.RequestError) as e:
            service.check_upload(name, content)
        assert e.value.status == status
    with pytest.raises(service.RequestError):
        engine.recommend(" ")


def test_requirements(spark):
    items = spark.createDataFrame([(1, "Procure 100 stainless steel water storage tanks for outdoor installation, minimum capacity 500 litres, resistant to corrosion, to IS 269")], "item_id long, raw string")
    r = search.requirements(items, {"material": ["stainless steel"], "property": ["corrosion resistant"], "environment": ["outdoor"]}).first()
    assert (r["product"], r["material"], r["property"], r["environment"]) == ("water storage tank", ["stainless steel"], ["corrosion resistant"], ["outdoor"])
    assert [(q["value"], q["unit"]) for q in r["quantities"]] == [(500.0, "L")]


SCOPE = "This standard covers rotational moulded polyethylene water storage tanks for use in buildings and other places where water is kept"
HEAD = "<p>IS 12701 : 1996</p><p>ICS 83.140.99 PCD 12 (1)</p><p>Reaffirmed 2018</p><p>FOREWORD</p><p>text</p>"


@pytest.mark.parametrize(
    ("page", "status", "more"),
    [
        (HEAD + f"<p>1 SCOPE</p><p>{SCOPE}</p><p>2 REFERENCES</p><p>IS 2062 (Part 1) : 2011, 456 : 2000</p><p>3 Terminology</p>", "ok", {"n_refs": 2, "found_by": "heading", "ics": "83.140.99", "committee": "PCD 12", "reaffirmed_year": 2018, "scope_text": SCOPE}),
        (HEAD + f"<p>{SCOPE}</p><p>3 Terms</p>", "ok", {"found_by": "opener"}),
        (HEAD + "<p>1 SCOPE</p><p>tanks only</p>", "too_short", {"scope_words": 2}),
        (HEAD + "<p>1 SCOPE</p><p>" + "polyethylene tanks " * 400 + "</p>", "too_long", {"scope_words": 632}),
        (HEAD + "<p>1 SCOPE</p><p>" + "wooden doors and frames for all houses of the land in every size they come</p>", "low_title_overlap", {}),
        ("<p>IS 99 : 1999</p><p>1 SCOPE</p>", "wrong_standard", {"page_is_number": "IS 99"}),
        ("<p>National Foreword</p>", "foreword_only", {}),
        ("", "no_scope_heading", {}),
        (None, "no_scope_heading", {}),
    ],
)
def test_previews(page, status, more):
    got = preview.parse_preview(page, "Rotational moulded polyethylene water storage tanks", "IS 12701")
    assert got["scope_status"] == status and {k: got[k] for k in more} == more


def test_preview_column(spark):
    df = spark.createDataFrame([(HEAD + f"<p>1 SCOPE</p><p>{SCOPE}</p>", "water storage tanks", "IS 12701"), (None, None, None)], "p string, t string, e string")
    assert [r["x"]["scope_status"] for r in df.select(preview.preview(F.col("p"), F.col("t"), F.col("e")).alias("x")).collect()] == ["ok", "no_scope_heading"]


def test_languages_and_glossary(spark):
    df = spark.createDataFrame([("hi",), ("Hindi",), ("hin_Deva",), ("ta-IN",), ("xx",)], "l string")
    assert [r["x"] for r in df.select(translation.resolve_language(F.col("l")).alias("x")).collect()] == ["hin_Deva", "hin_Deva", "hin_Deva", "tam_Taml", None]
    texts = spark.createDataFrame([(1, "hin_Latn", "TMT sariya, loha ki chadar aur pani"), (2, "hin_Latn", "sariyaon")], "id long, lang string, text string")
    glossary = spark.createDataFrame([("hin_Latn", "sariya", "steel bar"), ("hin_Latn", "pan", "never"), ("hin_Latn", "loha ki chadar", "iron sheet"), ("tam_Taml", "pani", "x")], "lang string, term string, english string")
    hits = translation.glossary_hits(texts, glossary)
    assert {(r["id"], r["term"]) for r in hits.collect()} == {(1, "sariya"), (1, "loha ki chadar"), (2, "sariya")}
    out = translation.augment(spark.createDataFrame([(1, "TMT Steel"), (3, "x")], "id long, query string"), hits)
    assert {r["id"]: r["query"] for r in out.collect()} == {1: "TMT Steel iron sheet bar", 3: "x"}


def test_translation(spark):
    df = spark.createDataFrame([(1, "पाइप IS 1786"), (2, "steel pipes of the house"), (3, "IS 1786 Fe500D"), (4, None), (5, "குழாய்"), (6, "पाइप IS 1786")], "id long, text string")
    calls = lambda texts, code: [f"pipe<{code}>" for _ in texts] if code == "hin_Deva" else 1 / 0
    got = {r["id"]: (r["english"], r["engine"], r["note"]) for r in translation.translate(df, calls).collect()}
    assert got[1] == got[6] == ("pipe<hin_Deva> IS 1786", "model", None)
    assert got[2][2] == "already English" and got[3][1] == "none" and got[4][0] == ""
    assert got[5] == ("குழாய்", "none", "translator failed: ZeroDivisionError")
    assert {r["note"] for r in translation.translate(df.where("id = 5"), None).collect()} == {"translation disabled"}
    lab = translation.localise(spark.createDataFrame([("Related",), ("Other",)], "label string"), spark.createDataFrame([("urd_Arab", "Related", "متعلقہ")], "lang string, label string, text string"), "urd_Arab")
    assert {r["label"]: (r["localized"], r["rtl"]) for r in lab.collect()} == {"Related": ("متعلقہ", True), "Other": ("Other", True)}


def test_evaluation_set(spark, index):
    a = "Providing and fixing high strength deformed bars conforming to IS 1786, cut and bent to shape as drawn. Next sentence."
    b = "Supplying structural steel plates of several thicknesses to IS 2062, painted twice before they leave the works. End."
    docs = spark.createDataFrame([(1, a + " " + b), (2, a), (3, "Laying of pipes to IS 77777 along the road in trenches of fair depth and width. X"), (4, "Filling IS 1786 bars. Y"), (5, None)], "doc_id long, text string")
    got = evaluation.build(docs, index.where("status = 'current'"), index.withColumn("replaced_by_id", F.lit(None).cast("long")))
    rows = {r["text"]: r["gold"] for r in got.collect()}
    assert list(rows.values()) in ([["IS 1786"], ["IS 2062 (Part 1)"]], [["IS 2062 (Part 1)"], ["IS 1786"]])
    assert all("IS" not in t for t in rows)
    keep = got.where("gold[0] = 'IS 1786'").select("id")
    assert evaluation.build(docs, index.where("status = 'current'"), index.withColumn("replaced_by_id", F.lit(None).cast("long")), rejected=keep).count() == 1


def test_cited_items(spark, index):
    far = "x" * 701
    docs = ["Providing X as per IS: 2911 (Part-IV) / 1234 done. Next Supply of B to IS 456:2000 and I.S. 1786, ( ) 12.50 each Nos 5 6 end Laying none", f"Laying {far} IS 456", "no opener IS 456", None, "Supply of A conforming to IS 12 (Part 1/Sec 2). Then", "Filling up to IS 99 " + "y " * 400]
    got = evaluation.cited_items(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["pos"], r["cited"]) for r in got] == [(0, 0, ["IS 2911 (Part 4)", "IS 1234"]), (0, docs[0].index("Supply"), ["IS 456", "IS 1786"]), (4, 0, ["IS 12 (Part 1) (Sec 2)"]), (5, 0, ["IS 99"])]
    assert [r["text"] for r in got[:3]] == ["Providing X as per done", "Supply of B to and, each end", "Supply of A"]
    assert got[3]["raw"] == docs[5][: len("Filling up to IS 99 ") - 1 + 300]
    old = index.unionByName(spark.createDataFrame([(6, "IS 77:1970", "IS 77", 1970, "withdrawn", "x", None, None)], index.schema)).withColumn("replaced_by_id", F.when(F.col("kys_id") == 6, F.lit(2)))
    items = spark.createDataFrame([(1, 0, ["IS 77", "IS 2062", "IS 8"])], "doc_id long, pos int, cited array<string>")
    assert evaluation.gold_of(items, index.where("status = 'current'"), old.withColumn("replaced_by_id", F.col("replaced_by_id").cast("long"))).first()["gold"] == ["IS 456", "IS 2062 (Part 1)"]
    assert spark.range(1).select(evaluation.is_constituent(F.lit("Anodized handles"), F.array(F.lit("IS 1868")))).first()[0] is True


def test_thresholds(spark):
    s = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 4.0), (1, 4, 8.0), (1, 5, 99.0)], "item_id long, doc_id long, score double")
    gold = spark.createDataFrame([(1, k) for k in range(1, 5)], "item_id long, doc_id long")
    assert tuple(evaluation.fit_thresholds(evaluation.scores_by_gold(s, gold)).first()) == (1.9, 1.15)
    assert evaluation.grid(lambda n: None if n == 0 else spark.range(n).agg(F.count(F.lit(1)).alias("n")), {"a": {"n": 2}, "b": {"n": 0}}).count() == 1
