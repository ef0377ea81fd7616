"""Tables in the order of a key."""

from pyspark.sql import functions as F

from specweave.sources import ordered


def _table(spark, tmp_path, n=2000):
    rows = spark.range(n).select(F.when(F.col("id") % 97 != 0, F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("v"), F.repeat(F.lit("x"), 50).alias("pad"))
    ordered.write(rows, str(tmp_path), ["k", "v"], file_rows=200)
    return rows, ordered.Ordered(spark, str(tmp_path), ["k", "v"])


def test_places_are_those_of_a_sort(spark, tmp_path):
    rows, table = _table(spark, tmp_path)
    want = sorted(((r["k"] is not None, r["k"] or 0, r["v"]) for r in rows.collect()))
    got = [(r["k"] is not None, r["k"] or 0, r["v"]) for r in table.placed().orderBy("place").collect()]
    assert got == want and sorted(r["place"] for r in table.placed().select("place").collect()) == list(range(len(want)))
    plan = table.placed()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_a_lookup_opens_few_files(spark, tmp_path):
    rows, table = _table(spark, tmp_path)
    wanted = spark.createDataFrame([(5,), (6,), (None,), (99_999,)], "k long")
    got = table.lookup(wanted)
    assert sorted(r["v"] for r in got.collect()) == sorted(r["v"] for r in rows.where("k in (5, 6)").collect())
    assert len(table.rows().inputFiles()) >= 8 and len(got.inputFiles()) <= 2
    assert "In(k" in got._jdf.queryExecution().executedPlan().toString()
    many = spark.range(0, 1009).select(F.col("id").alias("k"))
    assert table.lookup(many, named=10).count() == rows.where("k is not null").count()
    assert table.lookup(wanted.where("k > 9999")).count() == table.lookup(wanted.limit(0)).count() == 0


def test_an_empty_table_has_no_place(spark, tmp_path):
    ordered.write(spark.createDataFrame([], "k long, v long"), str(tmp_path), ["k", "v"])
    table = ordered.Ordered(spark, str(tmp_path), ["k", "v"])
    assert table.placed().count() == 0 and table.lookup(spark.createDataFrame([(1,)], "k long")).count() == 0
