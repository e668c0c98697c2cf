"""Tables, logs and the shared folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import members, nutrition, vectors
from larder.sources import files, schemas, scratch


def test_tables_keep_their_schema(spark, tmp_path):
    users = spark.createDataFrame([], schemas.USERS)
    users.write.parquet(str(tmp_path / "users"))
    assert files.read_table(spark, str(tmp_path / "users"), schemas.USERS).dtypes == users.dtypes


def test_log_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "logs")
    picks = spark.createDataFrame([("a", "Lunch", "dal", 250.0), ("a", "Dinner", "soup", None)],
                                  "username string, meal_type string, recipe_name string, kcal double")
    for day in ("2024-01-29", "2024-01-30"):
        files.append_rows(nutrition.log_rows(picks, day), path, "date")
    rows = spark.read.parquet(path)
    assert rows.count() == 4
    assert {r.calories_per_serving_kcal for r in rows.collect()} == {250.0, 0.0}
    days = nutrition.daily_calories(rows.withColumn("date", F.col("date").cast("date"))).collect()
    assert {r.date: r.total_calories for r in days} == {dt.date(2024, 1, 29): 250.0, dt.date(2024, 1, 30): 250.0}


def test_user_lookup_reads_by_key(spark, tmp_path):
    path = str(tmp_path / "users")
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "username string, tdee double").write.parquet(path)
    found = members.find_user(files.read_table(spark, path), "b")
    assert found.first().tdee == 2.0
    assert "EqualTo(username,b)" in found._jdf.queryExecution().executedPlan().toString()


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([("a", "2024-01-30", "r", 1.0)], "username string, d string, recipe_name string, calories_per_serving_kcal double").select(
        "username", F.col("d").cast("date").alias("date"), "recipe_name", "calories_per_serving_kcal").write.parquet(path)
    users = spark.createDataFrame([("a", "m", 1.0)], "username string, email string, tdee double")
    plan = nutrition.critical_low(users, files.read_table(spark, path), "2024-01-30")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-01-24)" in plan
    assert "ReadSchema: struct<username:string,date:date,calories_per_serving_kcal:double>" in plan


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch.new_dir(spark, "x").startswith(f"{named}/larder-{spark.sparkContext.applicationId}/x-")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    users = spark.createDataFrame([(f"u{i}", f"m{i}", 2000.0) for i in range(50)], "username string, email string, tdee double")
    logs = spark.createDataFrame(
        [(f"u{i % 60}", "2024-01-30", f"r{i}", 100.0) for i in range(200)],
        "username string, d string, recipe_name string, calories_per_serving_kcal double").withColumn("date", F.col("d").cast("date"))
    plain = nutrition.daily_summary(users, logs, "2024-01-30")
    try:
        files.write_bucketed(users, "bucketed_users", "username", 4, str(tmp_path / "users"))
        files.write_bucketed(logs, "bucketed_logs", "username", 4, str(tmp_path / "logs"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        laid_out = nutrition.daily_summary(spark.table("bucketed_users"), spark.table("bucketed_logs"), "2024-01-30")
        assert "Exchange" in plan_of(plain) and "Exchange" not in plan_of(laid_out)
        assert sorted(map(str, laid_out.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_users")
        spark.sql("DROP TABLE IF EXISTS bucketed_logs")


def test_vectors_by_condition_are_pruned(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([(f"c{i}", [1.0, float(i)], f"k{i % 3}") for i in range(9)],
                                 "chunk_id string, embedding array<float>, condition string")
    files.append_rows(rows, path, "condition")
    best = vectors.top_k(spark.read.parquet(path), [1.0, 0.0], ["k1"], 2)
    assert [r.chunk_id for r in best.collect()] == ["c1", "c4"]
    assert "PartitionFilters: [isnotnull(condition" in plan_of(best) or "PartitionFilters: [(condition" in plan_of(best)


def test_working_folder_is_gone_with_the_driver(tmp_path):
    import subprocess
    import sys

    code = (
        "from larder.session import build_session\nfrom larder.sources import scratch\n"
        f"spark = build_session('s', 'local[1]', **{{'spark.checkpoint.dir': '{tmp_path}/shared', 'spark.ui.enabled': 'false'}})\n"
        "path = scratch.new_dir(spark, 'x')\nspark.range(3).write.parquet(path)\n"
        "assert spark.read.parquet(path).count() == 3\nspark.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    assert list((tmp_path / "shared").glob("larder-*")) == []


def test_clean_removes_what_was_written(spark):
    from larder.sources import scratch

    path = scratch.new_dir(spark, "y")
    spark.range(3).write.parquet(path)
    scratch.remove(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_recipes_are_packed_and_read_by_index(spark, tmp_path):
    rows = spark.range(30_000).selectExpr(
        "concat('r', lpad(cast(id div 3 AS string), 5, '0')) AS recipe_name", "concat('a', id % 3) AS attribute",
        "CASE WHEN id % 7 = 0 THEN 'x, \"y\"' WHEN id % 11 = 0 THEN NULL ELSE cast(id AS string) END AS value", "'g' AS unit", "cast(id % 3 AS int) AS position")
    path = str(tmp_path / "packed")
    files.write_packed_csvs(rows, path, 3_000)
    assert 8 <= len(list((tmp_path / "packed" / "rows").glob("part-*"))) <= 12
    assert sorted(map(str, files.read_packed_recipes(spark, path).collect())) == sorted(map(str, rows.drop("position").collect()))
    one = files.read_packed_recipes(spark, path, ["r00500"])
    assert len(one.inputFiles()) == 1 and one.count() == 3
    assert files.read_packed_recipes(spark, path, ["unknown"]).count() == 0


def test_files_are_loaded_once_until_they_change(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    (folder / "dal.csv").write_text("Nutrient,Amount per Serving,Unit\nFat,1.0,g\nbad,1,2,3\n")
    load = lambda: files.load_new_csvs(spark, str(folder), ledger)
    rows, rejects, new = load()
    assert [tuple(r) for r in rows.collect()] == [("dal", "Fat", "1.0")]
    assert [(r.recipe_name, r.line) for r in rejects.collect()] == [("dal", "bad,1,2,3")] and rejects.first().file.endswith("/in/dal.csv")
    assert load()[0].count() == 1  # not marked yet
    files.mark_loaded(new, ledger)
    assert load()[0].count() == 0 and load()[1].count() == 0
    import os

    (folder / "soup.csv").write_text("Nutrient,Amount per Serving,Unit\nSalt,2.0,g\n")
    os.utime(folder / "dal.csv", (2_000_000_000, 2_000_000_000))
    assert sorted(r.recipe_name for r in load()[0].collect()) == ["dal", "soup"]


def test_index_of_packed_recipes_is_not_written_by_one_task(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("concat('r', id div 4) AS recipe_name", "'a' AS attribute", "'1' AS value", "'g' AS unit", "id AS position")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_packed_csvs(rows, str(tmp_path), 4_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert len(list((tmp_path / "index").glob("part-*"))) > 1
    assert index.select("recipe_name").distinct().count() == 5_000 and index.count() == index.distinct().count()
    assert files.read_packed_recipes(spark, str(tmp_path), ["r17", "r4999"]).count() == 8
