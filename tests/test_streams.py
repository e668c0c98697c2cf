"""Streaming jobs on small files."""

import json

from pyspark.sql import functions as F

from larder.operators import nutrition, recipes
from larder.plans.stream_queries import stream_view
from larder.plans.views import view
from larder.sources import schemas
from larder.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


def write_csv(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv").write_text("Nutrient,Amount per Serving,Unit\n" + "".join(f"{a},{v},g\n" for a, v in rows))


def test_only_new_files_are_loaded(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: jobs.load_new_files(jobs.stream_recipe_csvs(spark, str(source)), target, mark).awaitTermination()
    read = lambda: sorted((r.recipe_name, r.attribute) for r in spark.read.parquet(target).collect())
    write_csv(source / "a", "a", [("Fat", 1), ("Fiber", 2)])
    run()
    run()
    assert read() == [("a", "Fat"), ("a", "Fiber")]
    write_csv(source / "b", "b", [("Fat", 3)])
    run()
    assert read() == [("a", "Fat"), ("a", "Fiber"), ("b", "Fat")]


def test_new_json_pages_become_tall_rows(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()

    def put(name, label):
        recipe = {"label": label, "url": "u", "image": "i", "yield": 2, "calories": 100.0}
        (source / name).write_text(json.dumps({"hits": [{"recipe": recipe}]}, indent=1))
        tall = recipes.unpivot_nutrients(recipes.explode_hits(jobs.stream_recipe_json(spark, str(source))))
        jobs.load_new_files(tall, target, mark).awaitTermination()
        return sorted({r.recipe_name for r in spark.read.parquet(target).collect()}), spark.read.parquet(target).count()

    assert put("1.json", "Dal") == (["dal"], 5)
    assert put("2.json", "Roti") == (["dal", "roti"], 10)


def test_new_keys_only_and_replay(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: jobs.append_new_keys(
        jobs.stream_recipe_csvs(spark, str(source)), "recipe_name", target, mark).awaitTermination()
    read = lambda: sorted((r.recipe_name, r.value) for r in spark.read.parquet(target).collect())
    write_csv(source / "one", "a", [("Fat", 1)])
    run()
    write_csv(source / "two", "a", [("Fat", 9)])
    write_csv(source / "two", "b", [("Fat", 2)])
    run()
    assert read() == [("a", "1"), ("b", "2")]
    # A batch written again replaces its own part only.
    again = spark.createDataFrame([("b", "Fat", "2")], schemas.RAW_RECIPES)
    jobs._write_batch(again, target, 1)
    assert read() == [("a", "1"), ("b", "2")]


def test_upsert_log(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = schemas.CHUNKS + ", version int"

    def put(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.upsert_chunks(spark.readStream.schema(schema).parquet(source), target, mark).awaitTermination()

    put([("a", [1.0], "c", "f", 0, "old", 1), ("b", [1.0], "c", "f", 1, "b", 1), ("e", [], "c", "f", 2, "none", 1)])
    put([("a", [1.0], "c", "f", 0, "new", 1), ("a", [1.0], "c", "f", 0, "newer", 2)])
    assert sorted((r.chunk_id, r.text) for r in jobs.read_latest(spark, target).collect()) == [("a", "newer"), ("b", "b")]


def test_streamed_days_equal_batch_days(spark, tmp_path):
    streamed = jobs.daily_totals(stream_view(spark, SF_DIR, "logs"))
    jobs.write_closed_windows(streamed, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {(r.username, str(r.date)): r.total_kcal for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = nutrition.daily_calories(view(spark, SF_DIR, "logs")).collect()
    expected = {(r.username, str(r.date)): r.total_calories for r in batch}
    assert got and all(expected[k] == v for k, v in got.items())
    assert {k[1] for k in expected} - {k[1] for k in got} <= {"2024-01-29", "2024-01-30"}


def test_late_rows_are_dropped(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "username string, ts timestamp, recipe_name string, calories_per_serving_kcal double"

    def put(rows):
        spark.createDataFrame(rows, "username string, at string, recipe_name string, kcal double").select(
            "username", F.col("at").cast("timestamp").alias("ts"), "recipe_name", F.col("kcal").alias("calories_per_serving_kcal")
        ).write.mode("append").parquet(source)
        rows = jobs.daily_totals(spark.readStream.schema(schema).parquet(source))
        jobs.write_closed_windows(rows, target, mark).awaitTermination()

    put([("u", "2024-01-01 10:00:00", "r", 100.0), ("u", "2024-01-05 10:00:00", "r", 1.0)])
    put([("u", "2024-01-01 11:00:00", "r", 900.0), ("u", "2024-01-08 10:00:00", "r", 1.0)])
    got = {str(r.date): r.total_kcal for r in spark.read.parquet(target).collect()}
    assert got == {"2024-01-01": 100.0, "2024-01-05": 1.0}


def test_repeats_are_dropped(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for part in ([("a", 1), ("b", 1), ("a", 2)], [("b", 3), ("c", 3)]):
        spark.createDataFrame(part, "slug string, n int").write.mode("append").parquet(source)
        rows = jobs.drop_repeats_forever(spark.readStream.schema("slug string, n int").parquet(source), "slug")
        jobs.load_new_files(rows.select("slug"), target, mark).awaitTermination()
    assert sorted(r.slug for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_a_merge_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    target = str(tmp_path / "out")
    schema = "chunk_id string, embedding array<float>, condition string, source_file string, chunk_index long, text string"
    rows = spark.range(500).selectExpr("concat('k', id) AS chunk_id", "array(1f) AS embedding", "'c' AS condition", "'f' AS source_file", "id AS chunk_index", "'t' AS text")
    jobs._write_batch(rows, target, 0, "chunk_id")
    one = rows.filter("chunk_id = 'k7'")
    for known in (jobs.known_before(one, target, schema, "chunk_id", 1),
                  jobs.latest_buckets(spark, target, schema, jobs._touched(one, "chunk_id"), 1)):
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan
        read = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
        assert len(read) == 1 and 0 < known.count() < 40 and "k7" in {r.chunk_id for r in known.collect()}


def test_merges_replays_and_compaction(spark, tmp_path):
    import random

    rng = random.Random(3)
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema, want = schemas.CHUNKS + ", version int", {}
    for step in range(4):
        rows = [(f"k{rng.randrange(90)}", [float(step)], "c", "f", 0, f"{step}/{i}", i) for i in range(40)]
        want.update({r[0]: r[5] for r in sorted(rows, key=lambda r: r[6])})
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.upsert_chunks(spark.readStream.schema(schema).parquet(source), target, mark).awaitTermination()
    read = lambda: {r.chunk_id: r.text for r in jobs.read_latest(spark, target).collect()}
    assert read() == want and jobs.read_latest(spark, target).count() == len(want)
    jobs.compact(spark, target, ["chunk_id"])
    assert read() == want and spark.read.parquet(target).count() == len(want)
