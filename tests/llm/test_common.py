"""Byte-level scanning against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specweave.llm import common


def test_words_are_those_of_the_pattern():
    texts = ["  Ab c\t", "", "é日本 x", "\x0b\x0c", "one"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    starts, ends, first = common.words(buf, off)
    got = [[buf[starts[k] : ends[k]].tobytes().decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [["Ab", "c"], [], ["é日本", "x"], [], ["one"]]
    assert [int(h) for h in common.word_hashes(buf, starts, ends)] == [common.one_hash(w.lower().encode()) if w.isascii() else common.one_hash(w.encode()) for g in got for w in g]


@pytest.mark.parametrize("alphabet", [b"abcdefg   ", b"a"])
def test_long_texts_hash_as_short_ones_do(alphabet):
    buf = np.random.default_rng(0).choice(np.frombuffer(alphabet, np.uint8), 6 * common.CHUNK_BYTES)
    starts, ends, _ = common.words(buf, np.array([0, len(buf)]))
    assert (common.Spans(buf).hashes(starts, ends) == common.Spans(buf, whole=True).hashes(starts, ends)).all()


def test_chunks_cover_all_rows_and_keep_long_texts_whole():
    texts = [None, "", "abc", "x" * 1000, None, "yz", ""]
    got = []
    for lo, hi, buf, off in common.text_chunks(pa.chunked_array([texts[:3], texts[3:]], pa.string()), limit=10):
        assert len(off) == hi - lo + 1
        got += [(lo + i, buf[off[i] : off[i + 1]].tobytes().decode()) for i in range(hi - lo)]
    assert got == [(i, t or "") for i, t in enumerate(texts)]


def test_shingles_are_sets_of_word_runs():
    def sets(texts):
        raw = [t.encode() for t in texts]
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        starts, ends, first = common.words(buf, off)
        val, edge = common.shingles(common.word_hashes(buf, starts, ends), first)
        return [set(val[edge[i] : edge[i + 1]].tolist()) for i in range(len(texts))]

    a, b, c, d, e = sets(["a b c d e f", "x a b c d e f", "a b", "", "a b c d e a b c d e"])
    assert len(a) == 2 and len(a & b) == 2 and len(b) == 3 and len(c) == 1 and not d and len(e) == 5


def test_keys_are_hot_above_an_even_share_of_a_task(spark):
    """With many tasks, a key of one part in 5000 of all rows is more than a task's share."""
    counts = spark.createDataFrame([(i, 200_000_000 if i == 7 else 9) for i in range(50)], "k long, n long")
    total, key = 1_000_000_000_000, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    assert common.hot(counts, total, 10_000).count() == 0  # one part in 5000: with few tasks, less than a task's share
    try:
        spark.conf.set(key, "20000")
        assert [r["k"] for r in common.hot(counts, total, 10_000).collect()] == [7]
    finally:
        spark.conf.set(key, before)


def test_a_key_with_a_third_of_all_rows_is_joined_in_even_parts(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = common.store(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", F.col("k") * 2))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.join_in_parts(rows, keyed, ["k"], ["v"], 500)
        held = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(held) == 30_000 and max(held) < 2 * 30_000 / len(held) and out.where("mark <> 2 * k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
