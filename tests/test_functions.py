"""Worked examples of the text functions."""

import pytest
from pyspark.sql import functions as F

from specweave.functions import documents as D
from specweave.functions import requirements as R
from specweave.functions import language, notation, scoring, text

CITATIONS = [
    ("IS 1786:2008", ["IS 1786"]),
    ("is 456 - 2000", ["IS 456"]),
    ("IS 2911 (Part 1/Sec 4):2010", ["IS 2911 (Part 1)"]),
    ("IS 8329 Part 1", ["IS 8329 (Part 1)"]),
    ("conforming to IS/ISO 9001:2015", ["IS 9001"]),
    ("IS 1786 and IS 432", ["IS 1786", "IS 432"]),
    ("no standard here", []),
    (None, []),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("line", "want"), CITATIONS)
def test_citations_agree_as_column_and_as_parser(spark, line, want):
    assert D.citations(line) == want
    assert one(spark, text.citations("t"), t=line) == want


@pytest.mark.parametrize("digits", ["123456", "00123456", "9" * 5000])
def test_a_citation_has_its_whole_number(spark, digits):
    line, name = f"as per IS {digits} (Part 2):2004; pipe", f"IS {digits.lstrip('0')}"
    assert D.citations(line) == [f"{name} (Part 2)"] == one(spark, text.citations("t"), t=line)
    assert one(spark, text.strip_citations("t"), t=line) == "as per ; pipe"
    assert one(spark, text.base_id("t"), t=f"IS {digits}") == name


def test_a_mask_covers_the_whole_number():
    n = notation.Notation("bars IP66 as per IS 123456")
    assert n.masked() == "bars @1@ as per @2@" and n.values == ["IP66", "IS 123456"]


def test_digits_behind_a_mask_come_back_as_they_were():
    n = notation.Notation("as per IS 100012 Fe500D")
    assert n.restored(n.masked().translate(str.maketrans("123", "१२३"))) == (n.text, [])


@pytest.mark.parametrize("line", ["hot bolt_1  IP66 ", "IS 456 Part 1 bars", " M20", "a@1@b"])
def test_spaces_of_a_text_come_back_with_its_masks(line):
    n = notation.Notation(line)
    assert n.restored(n.masked()) == (line, [])


def test_masks_restored_changes_no_digit_of_the_prose(spark, tmp_path):
    """Digits that are no notation, spaces in a row and no name at all."""
    from specweave.plans import answer_queries

    names = ["hot bolt_1", "red  rod", " pad 2", "x_12_y", "a@1@b", None]
    rows = [(k, name, 7) for k, name in enumerate(names, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: (r["text"], r["missing"]) for r in answer_queries.masks_restored(spark, str(tmp_path)).collect()}
    assert got == {k: (name and f"{name} IP66 7 mm as per IS {k}{'' if k % 3 else ' Fe500D'}", 0) for k, name, _ in rows}


@pytest.mark.parametrize(("raw", "want"), [("Hexagon head bolts Part 1 ( Fifth Revision )", "Hexagon head bolts Part 1"), ("N/A", ""), (None, ""), ("a ? b--c", "a - b - c"), (" `x` ", "x")])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text("t"), t=raw) == want


def test_tokens_keep_vowel_signs_and_drop_stopwords(spark):
    assert one(spark, text.tokens("t"), t="The स्टील pipe_fitting of 25") == ["स्टील", "pipe", "fitting", "25"]


@pytest.mark.parametrize(("ref", "want"), [("IS 456:2000", "IS 456"), ("IS 2911 (Part 1/Sec 4):2010", "IS 2911 (Part 1/Sec 4)"), ("IS 1 to IS 5", None), ("IS 8329 (Part 2)", "IS 8329 (Part 2)")])
def test_base_id(spark, ref, want):
    assert one(spark, text.base_id("t"), t=ref) == want


@pytest.mark.parametrize(("line", "want"), [("Technical Specification:", True), ("SECTION B - SANITARY", True), ("GENERAL CONDITIONS", True), ("GI PIPES 25 MM MEDIUM CLASS", False), ("Sl No Description Qty", True), ("WORKS AS PER IS 456", False)])
def test_headings(spark, line, want):
    assert D.is_heading(line) is want
    assert one(spark, text.is_heading("t"), t=line) is want


@pytest.mark.parametrize(("phrase", "want"), [("water tanks", "water tank"), ("batteries", "battery"), ("glass", "glass"), ("switches", "switch"), ("bus", "bus")])
def test_singular(spark, phrase, want):
    assert R.singular(phrase) == want
    assert one(spark, text.singular("t"), t=phrase) == want


def test_json_and_clauses(spark):
    assert one(spark, text.json_object("t"), t='so: ```json\n{"a": 1}\n``` end') == '{"a": 1}'
    assert one(spark, text.json_object("t"), t="none") is None
    assert one(spark, text.cites_unknown_clause(F.col("a"), F.col("b")), a="see clause 4.2", b="Pipes (Sec 3)") is True
    assert one(spark, text.cites_unknown_clause(F.col("a"), F.col("b")), a="as in Sec 3", b="Pipes (Sec 3)") is False


def test_segments():
    assert [t for t, _ in D.segments("a) hand pump  b) HDPE tank  c) sluice valve")] == ["hand pump", "HDPE tank", "sluice valve"]
    assert D.segments("Water tank\nMaterial: steel\nCapacity: 500 L\nWarranty: 2 years")[0][0] == "Water tank, steel, 500 L"
    assert [t for t, _ in D.segments("pumps for the water\ndistribution network.\nNext item here")] == ["pumps for the water distribution network.", "Next item here"]
    assert D.segments("") == [] and D.segments(None) == []
    assert len(D.segments("as per IS 8329 (Part 1) pipes of iron")) == 1


def test_quantities():
    line = "Procure 100 stainless steel water storage tanks for outdoor installation, minimum capacity 500 litres, resistant to corrosion"
    (q,) = R.quantities(line)
    assert (q.value, q.unit, q.field, q.qualifier) == (500, "L", "capacity", "minimum")
    assert R.product(line, ["stainless steel"]) == "water storage tank"
    assert R.terms_in(R.rephrase(line), ["corrosion resistant", "corrosion"]) == ["corrosion resistant"]
    (q,) = R.quantities("8 mm to 32 mm diameter")
    assert (q.value, q.value_max) == (8, 32)
    assert len(R.quantities("25 mm bore and 40 mm pipe")) == 2
    assert [(q.unit, q.value) for q in R.quantities("DN 150")] == [("DN", 150)]
    assert R.quantities("1,00,000 L")[0].value == 100_000
    assert R.quantities("32 mm diameter, quantity 45 MT")[-1].field == "weight"
    assert R.quantities("conforming to IS 269 MT") == [] and R.quantities(None) == []


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Fixtures and fittings", "Fixture"), ("Forged steel flanges", "Forged steel flange"), ("Offset printing paper", "Offset printing paper"), ("Theodolite tripods", "Theodolite tripod"), ("Andesite aggregate", "Andesite aggregate"),
        ("Erection of steel towers", "steel tower"), ("Providing and fixing white vitreous china water closet pan", "white vitreous china water closet"), ("Paint, synthetic enamel", "Paint"), ("Fittings of brass", "Fitting"),
        ("Procurement of 2 sets of pump set for borewell", "pump set"), ("bars Fe 500D grade", "bar"), ("5 nos", None), (None, None), ("", None),
    ],
)
def test_products(line, want):
    assert R.product(line) == want


def test_requirements_of_pairs():
    got = R.requirements("Tank with a lid, galvanised", [("Material", "SS 304 / HDPE"), ("Bore", "25 mm"), ("Colour", "blue"), ("Load", "none"), ("Item", "Water tanks"), ("Finish", "Painted and polished")], {"property": ["galvanised", "painted"]})
    assert (got["product"], got["material"], got["property"], got["unmapped"]) == ("Water tank", ["SS 304", "HDPE"], ["Painted", "polished", "galvanised"], ["Colour: blue"])
    assert [(q.value, q.unit, q.field) for q in got["quantities"]] == [(25, "mm", "diameter")]


def test_lines_and_blocks():
    assert D.rejoin("Material: steel\nplates of 5 mm\nGENERAL\nmore\n1 row here\nand on\nlast;\nnext") == ["Material: steel plates of 5 mm", "GENERAL", "more", "1 row here", "and on last;", "next"]
    assert [t for t, _ in D.segments("Colour: sky blue\nPipes of cast iron")] == ["Colour: sky blue", "Pipes of cast iron"]
    assert [t for t, _ in D.segments("Pipes of cast iron\nColour: sky blue")] == ["Pipes of cast iron", "Colour: sky blue"]
    assert D.segments("Item: Valves\nSize: 25 mm\nMake: any\nGate valves of brass") == [("Valves, 25 mm", [("Item", "Valves"), ("Size", "25 mm"), ("Make", "any")]), ("Gate valves of brass", [])]


def test_queries_of_columns_are_those_of_the_parser(spark):
    lines = ["3 G.I. pipes 25 mm as per IS 1239, qty 500 nos", "nominal bore pipes no. 4", "स्टील पाइप 25 mm • ISI marked ÉTÉ; brand: x", "TENDER for 12,345 units @ 5% – Rs. 4", "", None, "a\u00a0b\u2003c (x) & y/z+w-v_u", "IS 456 (Part 2) concrete SHALL BE SUPPLIED"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r["i"]: r["q"] for r in df.select("i", D.query_column(F.col("t")).alias("q")).collect()}
    assert [got[i] for i in range(len(lines))] == [D.query_text(t) for t in lines]


def test_glued_words():
    costs = D.word_costs("the of and installing testing supplying commissioning pipes gi treatment construction".split())
    assert D.split_glued("Supplying,installing,testingandcommissioningofGIpipes", costs) == "Supplying, installing, testing and commissioning of gi pipes"
    assert D.split_glued("treatement construcion", costs) == "treatement construcion"


def test_word_split_knows_every_word_of_the_corpus(spark, tmp_path):
    from specweave.plans import udf_queries

    letters = "bcdfghjklm"
    common = [f"w{''.join(letters[int(c)] for c in f'{i:05}')}" for i in range(50_500)]  # all more frequent than the words that are asked for
    docs = [(i, " ".join(common[i::10] * 2)) for i in range(10)] + [(10, "testing pipework"), (11, "Ünïcode")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "testing pipework"), (2, "testing,nothing unheard"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["split"] for r in udf_queries.word_split(spark, str(tmp_path)).collect()}
    assert got[1] == "testing pipework" and got[2] == "testing nothingunheard" and got[3] == ""


def test_query_text():
    assert D.query_text("3 G.I. pipes 25 mm as per IS 1239, qty 500 nos") == "G.I. pipes"
    assert "nominal" in D.query_text("nominal bore pipes no. 4")


@pytest.mark.parametrize(
    ("said", "written"),
    [("eye ess seventeen eighty six", "IS 1786"), ("twenty five millimetre", "25 mm"), ("dee en one hundred fifty", "DN 150"), ("IS-1786 TMT bars", "IS 1786 TMT bars"), ("M 25 mm", "M 25 mm"), ("GI 25 mm pipe", "GI 25 mm pipe"), ("I see you are here", "I see you are here"), ("", ""),
     ("आई एस सत्रह सौ छियासी", "IS 1786"), ("आईएस चार सौ छप्पन के अनुसार", "IS 456 के अनुसार"), ("Fay five hundred bars", "Fe500 bars"), ("dee en five", "DN 5"), ("eye ess one seven eight six", "IS 1786"),
     ("two lakh fifty thousand litres", "250000 L"), ("IP sixty six lamp", "IP66 lamp"), ("one hundred", "one hundred"), ("oh I see", "oh I see"), ("IS-1786 bars", "IS 1786 bars"), ("IS 1786 bars of 5 bars", "IS 1786 bars of 5 bar"), ("पच्चीस litres", "25 L")],
)
def test_spoken_notation(said, written):
    assert notation.spoken(said)[0] == written


def test_masks(spark):
    line = "90W LED street light IP66 as per IS 10322:2014"
    n = notation.Notation(line)
    assert n.masked() == "@1@ LED street light @2@ as per @3@" and n.kinds == ["quantity", "code", "citation"]
    assert n.restored(n.masked()) == (line, [])
    assert n.restored("@ १ @ x @2@ @2@ @77@") == ("90W x IP66", ["IS 10322:2014"])
    lifted = notation.Notation("TMT bars Fe500D to IS 1786", notation.LIFTED)
    assert (lifted.prose(), lifted.values, lifted.behind("rods")) == ("TMT bars to", ["Fe500D", "IS 1786"], "rods Fe500D IS 1786")
    assert notation.Notation(None).masked() == "" and notation.Notation("no notation ;").prose() == "no notation ;"
    assert notation.spec_terms("90W, IP66 and ip 66") == [("90W", "quantity"), ("IP66", "code")]
    df = spark.createDataFrame([(line,), (None,)], "t string")
    back = df.select(notation.restored(notation.masked(F.col("t"))["text"], F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in back] == [(line, []), ("", [])]


@pytest.mark.parametrize(
    ("line", "code"),
    [("குழாய்", "tam_Taml"), ("ಕೊಳವೆ", "kan_Knda"), ("పైపు", "tel_Telu"), ("പൈപ്പ്", "mal_Mlym"), ("પાઇપ", "guj_Gujr"), ("ਪਾਈਪ", "pan_Guru"), ("ପାଇପ", "ory_Orya"), ("पाइप", "hin_Deva"), ("पाइप आहे आणि साठी", "mar_Deva"), ("TMT sariya Fe500D RCC kaam ke liye chahiye", "hin_Latn"), ("supply of the pipes", "eng_Latn"), ("", "eng_Latn")],
)
def test_languages(spark, line, code):
    assert one(spark, language.detect("t")["code"], t=line) == code


def test_digits_and_routes(spark):
    assert one(spark, language.fold_digits("t"), t="१२ ٣٤ 56") == "12 34 56"
    assert one(spark, language.non_latin_share("t"), t="ab गग") == pytest.approx(0.5)
    assert one(spark, language.script_share("t", "Devanagari"), t="") == 0


def test_scores(spark):
    assert one(spark, scoring.combine(F.lit(1.0), F.lit(scoring.MAX_BOOST)), t="") == pytest.approx(1.0)
    assert one(spark, scoring.tier(F.lit(0.82)), t="") == "Related"
    assert one(spark, scoring.boost(F.lit("Methods of Test"), F.lit(None).cast("boolean"), F.lit(None).cast("int"), 2026), t="") == pytest.approx(-0.03)
