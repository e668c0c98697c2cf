"""Structured Streaming jobs run to the end over a given table.

Each query streams a table's files into a new folder below the shared one and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans.registry import query
from larder.plans.views import TABLES, load, with_views
from larder.sources import scratch
from larder.streaming import jobs


def stream_view(spark, sf_dir: str, name: str):
    source, columns = TABLES[name]
    # A pattern takes the table whether it is one file or a folder of files.
    rows = spark.readStream.schema(load(spark, sf_dir, source).schema).parquet(f"{sf_dir}/{source}.parque[t]")
    return rows.selectExpr(*(f"{expr} AS `{alias}`" for alias, expr in columns.items()))


def _windows(spark, rows, name: str, keys: list[str]):
    """Run a windowed stream to its end; windows the watermark has not passed are part of the result."""
    folder = scratch.new_dir(spark, name)
    jobs.write_windows(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return jobs.read_windows(spark, f"{folder}/out", rows.schema, keys)


@query("stream_daily_summary", with_views(["logs"], """
SELECT username, date, sum(calories_per_serving_kcal) AS total_kcal, count(recipe_name) AS meal_count FROM logs
GROUP BY username, date"""))
def stream_daily_summary(spark, sf_dir):
    return _windows(spark, jobs.daily_totals(stream_view(spark, sf_dir, "logs")), "daily", ["username", "date"])


@query("stream_weekly_digest", with_views(["logs"], """
SELECT username, date + o AS week_end, round(avg(calories_per_serving_kcal), 6) AS avg_kcal, count(*) AS rows
FROM logs, (VALUES (0), (1), (2), (3), (4), (5), (6)) v(o)
GROUP BY username, date + o"""))
def stream_weekly_digest(spark, sf_dir):
    rows = _windows(spark, jobs.weekly_means(stream_view(spark, sf_dir, "logs")), "weekly", ["username", "week_end"])
    return rows.withColumn("avg_kcal", F.round("avg_kcal", 6))


@query("stream_first_seen", "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS username FROM events")
def stream_first_seen(spark, sf_dir):
    rows = stream_view(spark, sf_dir, "logs").select("username", "ts")
    folder = scratch.new_dir(spark, "seen")
    once = jobs.drop_repeats(rows, "username", "ts", "60 days").select("username")
    jobs.load_new_files(once, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/out")


@query("stream_incremental_append", with_views(["recipes"], """
SELECT recipe_name, calories_per_serving_kcal FROM recipes"""))
def stream_incremental_append(spark, sf_dir):
    """Load a recipe table, then load it again: the second run finds nothing new."""
    folder = scratch.new_dir(spark, "recipes")
    for run in (1, 2):
        rows = stream_view(spark, sf_dir, "recipes").select("recipe_name", "calories_per_serving_kcal")
        jobs.append_new_keys(rows, "recipe_name", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("recipe_name", "calories_per_serving_kcal")


@query("stream_upsert_chunks", with_views(["chunks"], """
SELECT chunk_id, condition, text || ' v' || CASE WHEN condition IN ('c0', 'c1', 'c2') THEN '2' ELSE '1' END AS text FROM chunks"""))
def stream_upsert_chunks(spark, sf_dir):
    """Two loads of the vector table: the second one replaces three conditions."""
    folder = scratch.new_dir(spark, "chunks")
    for run in (1, 2):
        rows = stream_view(spark, sf_dir, "chunks").withColumn("version", F.lit(run))
        if run == 2:
            rows = rows.filter("condition IN ('c0', 'c1', 'c2')")
        rows = rows.withColumn("text", F.concat("text", F.lit(f" v{run}")))
        jobs.upsert_chunks(rows, f"{folder}/out", f"{folder}/checkpoint-{run}", offset=run - 1).awaitTermination()
    return jobs.read_latest(spark, f"{folder}/out").select("chunk_id", "condition", "text")
