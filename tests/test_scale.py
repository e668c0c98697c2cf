"""Skew-safe building blocks against plain results, with one key holding a third of the rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from larder.operators import scale
from larder.plans import views


def skewed(n=3000, keys=40, seed=5):
    rng = random.Random(seed)
    return [(("hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}"), i, rng.randrange(10)) for i in range(n)]


def test_running_sum(spark):
    data = skewed()
    rows = spark.createDataFrame(data, "k string, i int, v int").repartition(7)
    for buckets in ([], [F.floor(F.col("i") / 16)], [F.floor(F.col("i") / 16), F.floor(F.col("i") / 256)]):
        got = {(r.k, r.i): r.s for r in scale.running_sum(rows, ["k"], ["i"], "v", buckets, "s").collect()}
        total = defaultdict(int)
        for k, i, v in data:
            total[k] += v
            assert got[k, i] == total[k]
        assert len(got) == len(data)


def test_running_sum_keeps_rows_with_nulls(spark):
    data = [("a", None, 5), ("a", 1, 2), ("a", 9, None), (None, 3, 1), (None, None, 4), ("b", None, None)]
    rows = spark.createDataFrame(data, "k string, i int, v int")
    for buckets in ([], [F.floor(F.col("i") / 4)], [F.floor(F.col("i") / 4), F.floor(F.col("i") / 8)]):
        got = {(r.k, r.i): r.s for r in scale.running_sum(rows, ["k"], ["i"], "v", buckets, "s").collect()}
        assert got == {("a", None): 5, ("a", 1): 7, ("a", 9): 7, (None, None): 4, (None, 3): 5, ("b", None): None}


def test_first_per_key_limits_before_the_shuffle(spark):
    rows = spark.createDataFrame(skewed(), "k string, i int, v int")
    frame = scale.first_per_key(rows, ["k"], [F.col("v"), F.col("i")], 2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    expected = defaultdict(list)
    for k, i, v in skewed():
        expected[k].append((v, i))
    got = defaultdict(list)
    for r in frame.collect():
        got[r.k].append((r.v, r.i))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:2] for k, v in expected.items()}


def test_concat_ordered_gives_one_text_per_key(spark):
    rows = spark.createDataFrame(
        [("a", i, f"t{i}", 1) for i in range(3000)] + [("b", 0, "x", 2), ("b", 1, None, 3), (None, 5, "n", 4)],
        "k string, i int, t string, n int").repartition(5)
    got = {r.k: (r.text, r.parts, r.n) for r in scale.concat_ordered(rows, ["k"], "i", "t", "|", totals=["n"]).collect()}
    assert got == {"a": ("|".join(f"t{i}" for i in range(3000)), 3000, 3000), "b": ("x", 1, 2), None: ("n", 1, 4)}


def test_settle_keeps_rows_and_schema(spark):
    rows = spark.createDataFrame(skewed(), "k string, i int, v int")
    kept = scale.settle(rows, "rows")
    assert kept.schema == rows.schema and kept.count() == rows.count()


def test_parts_are_dealt_out_before_they_become_tall_rows(spark, tmp_path, monkeypatch):
    rows = [(i, f"n{i}", "b", "t", i % 50) for i in range(5_000)] + [(None, None, None, None, None)] * 3_000 + [(7, "n7", "b", "t", 7)] * 3_000
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    whole = views.raw_recipes(spark, str(tmp_path))
    monkeypatch.setattr(views, "PARTS_PER_TASK", 2_000)
    dealt = views.raw_recipes(spark, str(tmp_path))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert whole.rdd.getNumPartitions() == 1 and len(sizes) > 1
    assert sum(sizes) == 11_000 * 14 and max(sizes) <= 3 * 2_000 * 14
    assert dealt.exceptAll(whole).count() == whole.exceptAll(dealt).count() == 0
