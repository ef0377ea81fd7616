"""The pipeline's stages, each against what it may and must do on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    d = str(tmp_path_factory.mktemp("corpus"))
    item = [word() for _ in range(30)]
    docs = []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(30, 90))]
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["zlurk", "vexpot", "qumble"])
        docs.append((i, " ".join(w), "en", f"s{min(i % 6, 3)}"))
    docs += [(1000 + i, docs[7][1] + f" tail{i}", "en", "s1") for i in range(20)]
    docs += [(1100 + i, " ".join([word() for _ in range(20)] + item[15:] + [word()] + item[:15]), "en", "s2") for i in range(5)]
    docs += [(1200, None, "en", "s1"), (1201, "", "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        at[name] = {r["doc_id"] for r in docs.collect()}
        if name != "sharding":
            assert docs.columns == columns
    toxic = {i for i in range(400) if i % 5 == 0}
    assert len(at["toxicity"] & toxic) <= 4 and len({i for i in range(400)} - toxic - at["toxicity"]) <= 4
    assert {1200, 1201} <= at["near_dedup"]
    assert at["near_dedup"] & {7, *range(1000, 1020)} == {7}
    assert not at["decontamination"] & set(range(1100, 1105)) and at["near_dedup"] - at["decontamination"] == set(range(1100, 1105)) & at["near_dedup"]
    shards = [r.asDict() for r in docs.collect()]
    assert len(shards) == before.count() and {r["shard"] for r in shards} <= set(range(24))


def test_contaminated_rows_go_by_doc_id_and_text(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(None, f"some words {item} more words"), (None, "clean and without an id"), (7, f"{item} again"), (7, "clean and of an id that another row has"), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, (r for r in rows if item not in (r[1] or ""))))


def test_run_gives_what_the_stages_give(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.run(spark, folder).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))


def test_columns_of_any_name_and_empty_tables_go_through(spark, folder, tmp_path):
    names = ["toxicity", "epochs", "taken_id", "epoch", "found", "times", "size", "key", "bin", "mark", "kept", "Taken_id_", "component_id"]
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    wide = whole
    for i, n in enumerate(names):
        wide = wide.withColumn(n, F.lit(f"own {i}"))
    for name, stage in corpus_pipeline.STAGES:
        plain, out, none = stage(spark, whole, folder), stage(spark, wide, folder), stage(spark, wide.limit(0), folder)
        assert none.columns == out.columns and none.count() == 0
        if name != "sharding":
            assert out.columns == wide.columns
            got = out.collect()
            assert got and all(r[n] == f"own {i}" for r in got for i, n in enumerate(names))
            assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((r["doc_id"], r["text"])) for r in plain.collect())
