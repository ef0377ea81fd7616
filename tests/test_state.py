"""Streams that hold state, translations that are remembered, glued words."""

import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from specweave.functions import documents as D
from specweave.operators import remembered, segmentation
from specweave.sources.merge import KeyedTable
from specweave.streaming import items

DOCS = {
    "a": "1. Deformed steel bars for works\n2. Polyethylene water\nstorage tanks of 500 litres; Gate valves of brass\n\nGENERAL\nItem: Valves\nSize: 25 mm\nMake: any\nlast of the lines here",
    "b": "Pipes of cast iron\nColour: sky blue",
    "c": "tiny",
    "d": "",
    "e": "Solar street lamps\r\nWattage: 90 W\r\nHeight: 9 m\r\n\r\nwhich stand on\r\npoles of steel Copper wires of many sizes",
    "f": "  \n ab \n",
}


def _batch(docs=DOCS):
    return {k: [(t, len(p)) for t, p in D.segments(v)] for k, v in docs.items()}


def _cuts(rnd, text):
    at = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 9)))
    return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_of_a_document_gives_the_items_of_the_whole(seed):
    rnd = random.Random(seed)
    for key, want in _batch().items():
        pieces = list(enumerate(_cuts(rnd, DOCS[key])))
        order = list(pieces)
        rnd.shuffle(order)
        doc, got = items.Unfinished(), []
        for seq, text in order:
            over = doc.take(seq, text, seq == len(pieces) - 1)
            doc = items.Unfinished(doc.saved())  # as it lies in the state store
            doc.said = len(got)
            got += doc.rest() if over else doc.closed()
        assert got == want, key


def test_state_does_not_grow_with_the_document():
    doc, most = items.Unfinished(), 0
    for k in range(3000):
        doc.take(k, f"{k % 9 + 1}. Item of number {k} in a long list\n", False)
        doc.said += len(doc.closed())
        most = max(most, len(doc.saved()))
    assert most < 1000 and doc.said == 2998


def test_a_stream_gives_the_rows_of_the_batch_form(spark, tmp_path):
    rnd, rows = random.Random(4), []
    at = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    for key, text in DOCS.items():
        cut = _cuts(rnd, text)
        # "b" never says that it is over: time closes it
        rows += [(key, k, p, k == len(cut) - 1 and key != "b", at) for k, p in enumerate(cut)]
    rnd.shuffle(rows)
    rows.append(("z", 0, "Much later comes this one", True, at + datetime.timedelta(days=1)))
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9], items.PIECES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, items.STORE)
    try:
        stream = spark.readStream.schema(items.PIECES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = items.stream_items(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    finally:
        spark.conf.set(key, before)
    got: dict = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["item"], r["n_pairs"]))
    assert got == {k: v for k, v in _batch({**DOCS, "z": "Much later comes this one"}).items() if v}


def test_translations_are_asked_for_once(spark, tmp_path):
    cache = KeyedTable(spark, f"{tmp_path}/cache", remembered.KEYS, remembered.SCHEMA, 4)
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(texts, code):
        import uuid

        for t in texts:
            (calls / uuid.uuid4().hex).write_text(t)
        return ["" if "नहीं" in t else f"<{t}>" for t in texts]

    frame = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id long, text string")
    ask = lambda n, *t, most=4096: {r["id"]: (r["english"], r["engine"]) for r in remembered.translate(frame(*t), cache, model, n, most=most).collect()}
    one = ask(1, "पाइप", "लोहा", "steel pipes of the house", None, "पाइप", "नहीं")
    assert one[0] == one[4] == ("<पाइप>", "model") and one[2][1] == "none" and one[3][0] == "" and one[5] == ("नहीं", "none")
    assert ask(2, "लोहा", "पाइप")[1] == ("<पाइप>", "model") and ask(2, "लोहा")[0] == ("<लोहा>", "model")
    asked = Counter(p.read_text() for p in calls.iterdir())
    assert asked == {"पाइप": 1, "लोहा": 1, "नहीं": 1}
    # what failed is asked for again; what was used longest ago goes when there are too many
    ask(3, "नहीं", "लोहा", "चादर", most=2)
    assert {r["text"] for r in cache.read().collect()} == {"लोहा", "चादर"}
    ask(4, "पाइप", most=2)
    assert Counter(p.read_text() for p in calls.iterdir()) == {"पाइप": 2, "लोहा": 1, "नहीं": 2, "चादर": 1}


def test_glued_words_come_back(spark):
    texts = spark.createDataFrame([(1, "the requirements for sizes of vitreous laboratory sinks and the sizes of sinks"), (2, "requirements for laboratory work, the work of laboratory"), (3, None)], "doc_id long, text string")
    model = segmentation.counted(texts)
    broken = spark.createDataFrame([(1, "requirements forsizes, (vitreouslaboratory) sinks\nofsinksand 12 Laboratorysinks"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in segmentation.unjoin(broken, model).collect()}
    assert got == {1: "requirements for sizes, (vitreous laboratory) sinks\nof sinks and 12 Laboratorysinks", 2: "", 3: None}


def test_ways_through_a_run_are_the_likeliest(spark):
    """Against all two- and three-word splits, written out."""
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("ab") for _ in range(rnd.randint(2, 5))) for _ in range(25)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(30))) for i in range(8)]
    words, pairs = Counter(), Counter()
    for _, t in rows:
        w = t.split()
        words.update(w)
        pairs.update(zip(w, w[1:], strict=False))
    total = sum(words.values())
    runs = sorted({"".join(rnd.choice(vocabulary) for _ in range(3)) for _ in range(60)} | {"abababababab", "bbbbbbbbbbbbbbbbbbbbbbbbbbbb"})
    runs = [r for r in runs if len(r) >= 8]
    after = lambda a, b: -math.log(pairs[a, b] / words[a]) if (a, b) in pairs else -math.log(0.4 * words[b] / total)
    want = {}
    for run in runs:
        n = len(run)
        ways = [(1, run, -math.log(words[run] / total) if run in words else math.log(total / 10) + n * math.log(10))]
        for i in range(2, n - 1):
            a, b = run[:i], run[i:]
            if a in words and b in words:
                ways.append((2, f"{a} {b}", -math.log(words[a] / total) + after(a, b)))
            for j in range(i + 2, n - 1):
                m, z = run[i:j], run[j:]
                if a in words and m in words and z in words:
                    ways.append((3, f"{a} {m} {z}", -math.log(words[a] / total) + after(a, m) + after(m, z)))
        want[run] = min((round(c, 6), k, w) for k, w, c in ways)[2]
    model = segmentation.counted(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["run"]: r["words"] for r in segmentation.split(spark.createDataFrame([(r,) for r in runs], "run string"), model).collect()}
    assert got == want


def test_cheapest_words_are_the_least_of_all_ways():
    rnd = random.Random(6)
    costs = {"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 6))): rnd.random() * 5 for _ in range(25)}

    def ways(run):
        if not run:
            yield 0.0, []
        for w, c in costs.items():
            if run.startswith(w):
                for more, rest in ways(run[len(w) :]):
                    yield c + more, [w, *rest]

    for _ in range(200):
        run = "".join(rnd.choice(list(costs)) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "c"])
        best = min(ways(run), default=(0, []))
        assert D.cheapest_words(run, costs) == best[1]
