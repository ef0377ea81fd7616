"""Mixing, sharding and line dedup against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from specweave.llm import common, line_dedup, mixing, sharding


def _rows(df):
    return [r.asDict() for r in df.collect()]


# --- mixing


def filled(sizes, weights=(5.0, 2.0, 1.0), times=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > times * sizes[s] + 1e-9]
        if not over:
            for s in open_:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = times * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) * rng.randrange(1, 9) for s in [None, "a", "b", "é", "z", "Z", "aa"]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in _rows(mixing.targets(df))}
    want = filled(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert got[s] <= 3 * sizes[s] + 1e-6
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_meets_targets_and_prefers_small_keys(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(1, 40)) + (" ###" if i % 4 == 0 else ""), f"s{min(i % 7, 4)}") for i in range(600)], "doc_id long, text string, source string")
    rows = _rows(mixing.mix(docs))
    again = _rows(mixing.mix(docs.repartition(7)))
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert max(r["epochs"] for r in mine) - min(r["epochs"] for r in mine) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)


def test_mix_bins_do_not_change_the_result(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 13), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    one = sorted(map(str, _rows(mixing.mix(docs))))
    monkeypatch.setattr(mixing, "BIN_ROWS", 10)
    assert sorted(map(str, _rows(mixing.mix(docs)))) == one


def test_no_bin_is_overfull(spark):
    # junk of the least weight, and one doc_id that holds a third of all rows
    junk, same = F.lit("# # # w"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    docs = spark.range(90_000).select(same.alias("doc_id"), F.when(F.col("id") % 2 == 0, junk).otherwise(F.lit("good words")).alias("text"), F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(F.lit("a")).alias("source"))
    held = [r["count"] for r in mixing.dealt(docs).groupBy("bin").count().collect()]
    assert sum(held) == 90_000 and len(held) == 90_000 // mixing.BIN_ROWS and max(held) <= 2 * mixing.BIN_ROWS


def test_mix_odd(odd, empty):
    rows = _rows(mixing.mix(odd))
    assert len(rows) == odd.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (0, 1, 2, 3))
    assert mixing.mix(empty).count() == 0
    assert _rows(mixing.mix(odd.where("doc_id = 1")))[0]["target"] == 0


# --- sharding


def check_shards(rows, docs, n, slack):
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for s, mine in by.items():
        assert 0 <= s < n
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    text = dict(docs)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    total = sum(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in mine) - total / n) <= slack for mine in by.values())
    return by


@pytest.mark.parametrize("range_rows", [50, 8192])
def test_shards_are_even_though_a_third_is_one_text(spark, range_rows):
    rng = random.Random(3)
    docs = [(i, "same text for all of them" if i % 3 == 0 else "x" * rng.randrange(200)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = _rows(sharding.shard(df, range_rows=range_rows))
    check_shards(rows, docs, 24, 450)
    assert sorted(map(str, rows)) == sorted(map(str, _rows(sharding.shard(df.repartition(5), range_rows=range_rows))))
    counts = {}
    for r in _rows(sharding.shard(df, law="rows", range_rows=range_rows)):
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24


def test_no_cell_is_overfull(spark):
    # short rows of one text beside long ones, and a doc_id that a third of all rows repeat with one text
    docs = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 3 == 1, F.lit("tiny")).otherwise(F.repeat(F.lit("y"), (5000 + F.col("id") % 100).cast("int"))).alias("text"),
    )
    held = [r["count"] for r in sharding.dealt(docs, range_rows=500)[0].groupBy("part", "sub").count().collect()]
    assert sum(held) == 20_000 and max(held) <= 2 * 500
    by = {}
    for r in _rows(sharding.shard(docs, range_rows=500)):
        by.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for mine in by.values() for r in mine)
    for mine in by.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 24) < 12_000


def test_small_groups_of_equal_texts_stay_together(spark):
    docs = [(i, f"text {i // 3} " + "y" * (i // 3 % 50)) for i in range(6000)]
    rows = _rows(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), keep=0.05))
    by = check_shards(rows, docs, 24, 2 * 3 * 70)
    where = {}
    for s, mine in by.items():
        for r in mine:
            where.setdefault(r["text_crc32"], set()).add(s)
    assert all(len(s) == 1 for s in where.values())


def test_shard_odd(odd, empty):
    rows = _rows(sharding.shard(odd))
    assert len(rows) == odd.count()
    assert {r["text_crc32"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert {r["size"] for r in rows if r["doc_id"] == 0} == {8}
    assert sharding.shard(empty).count() == 0


# --- line dedup


def plain_passages(docs, run=3, words=50, size=512):
    first, out = {}, {}
    lines = {d: (t or "").split("\n") for d, t in docs}

    def pieces(ls):
        for n in range(1, run + 1):
            for i in range(len(ls) - n + 1):
                w = ls[i : i + n]
                if n == run or sum(len(x.split()) for x in w) >= words or sum(len(x.encode()) for x in w) >= size:
                    yield ("l", *w), i, n
        if len(ls) < run and any(x.split() for x in ls):
            yield ("d", *ls), 0, len(ls)

    for d in sorted(lines):
        for key, i, _ in pieces(lines[d]):
            first.setdefault(key, (d, i))
    for d, ls in lines.items():
        gone = {j for key, i, n in pieces(ls) if first[key] != (d, i) for j in range(i, i + n)}
        out[d] = ("\n".join(x for j, x in enumerate(ls) if j not in gone), len(ls), len(gone), sum(j - 1 not in gone for j in gone))
    return out


@pytest.mark.parametrize(("run", "hot_rows"), [(2, 5), (3, 5), (3, 4096), (5, 4096)])
def test_runs_match_plain_python(spark, monkeypatch, run, hot_rows):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    rng = random.Random(run)
    docs = [(i, "\n".join(rng.choice("abcdefg") for _ in range(rng.randrange(30)))) for i in range(80)]
    docs += [(100 + i, "shared\nlines\nof\nmany\ntexts\n" + f"own {i}") for i in range(40)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in _rows(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run))}
    assert got == plain_passages(docs, run)


def test_fingerprints_are_window_minima_and_nothing_is_found_without_them(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "\n".join(rng.choice("abcdefghij") for _ in range(40))) for i in range(20)], "doc_id long, text string")
    hashed = {c: h for c, h in docs.select(F.explode(F.split("text", "\n")).alias("c")).distinct().select("c", F.xxhash64("c")).collect()}
    got = {(r["doc_id"], r["at"]) for r in _rows(line_dedup.places(docs, 3))}
    want = set()
    for d, t in docs.collect():
        h = [hashed[c] for c in t.split("\n")]
        want |= {(d, max(j for j in range(i, i + 3) if h[j] == min(h[i : i + 3])) + 1) for i in range(len(h) - 2)}
    assert got == want and len(want) < 20 * 38
    assert line_dedup.repeated(docs).count() > 0
    whole = line_dedup.places
    monkeypatch.setattr(line_dedup, "places", lambda d, run: whole(d, run).where("false"))
    assert line_dedup.repeated(docs).count() == 0


def test_passages_match_plain_python(spark):
    rng = random.Random(4)
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    half = [" ".join(f"{c}{i}" for i in range(30)) for c in "de"]
    docs = [(i, "\n".join(rng.choice([*"fghij", *long, *half, "", "  "]) for _ in range(rng.randrange(1, 6)))) for i in range(150)]
    docs += [(200, "one short line"), (201, "one short line"), (202, "one short line\nand more"), (203, "字" * 200 + "\nx"), (204, "y\n" + "字" * 200), (205, None), (206, ""), (207, " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in _rows(line_dedup.dedup_lines(frame))}
    assert got == plain_passages(docs)
    assert got[201][0] == "" and got[202][2] == 0 and got[204][0] == "y" and got[205][2] == got[206][2] == got[207][2] == 0


def test_passages_odd(spark, odd, empty):
    df = line_dedup.dedup_lines(odd)
    assert df.count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "x\ny\nz"), (2, "x\ny\nz"), (3, "p\nq\nr"), (3, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in _rows(line_dedup.dedup_lines(twice))) == [("1", 0), ("1", 0), ("2", 3), ("3", 0), ("3", 3), ("None", 0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_no_python_in_native_plans(spark, odd):
    for df in (sharding.shard(odd), line_dedup.dedup_lines(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert hashlib.sha256(b"").hexdigest() == odd.select(F.sha2(F.lit(""), 256)).first()[0]


def test_splitters_of_rows_that_share_a_doc_id(spark):
    """The sample draws rows, not ids: as many as of distinct ids, whichever id it is."""
    for doc_id in (1, 2, 13, None):
        docs = spark.range(30_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
        got = sharding.shard(docs, 24).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(got) == 24 and max(r["n"] for r in got) < 1.2 * 30_000 / 24
