"""Incremental jobs: load new files once, drop repeats, keyed merges, windowed summaries.

Every job takes its checkpoint location from the caller (a shared folder on a cluster). Targets lie in folders by batch and by
bucket of the key: a batch reads the buckets its own keys fall into, and writes a folder of its own, so that a
replayed batch replaces exactly what it wrote before.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from larder.operators import nutrition, recipes, scale
from larder.sources import files, schemas, scratch

KCAL = nutrition.KCAL
BUCKETS = 64


def stream_recipe_csvs(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.readStream.schema(schemas.RECIPE_CSV).options(**files.RECIPE_CSV_OPTIONS | {"mode": "DROPMALFORMED"}).csv(path)
        .select(F.regexp_replace("_metadata.file_name", r"\.csv$", "").alias("recipe_name"), "attribute", "value")
    )


def stream_recipe_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.RECIPE_PAGE).option("multiLine", True).json(path)


def load_new_files(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append files not loaded before; the checkpoint remembers which were."""
    return (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def drop_repeats(rows: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Pass a key once; the watermark bounds the state to `delay`."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def drop_repeats_forever(rows: DataFrame, key: str) -> DataFrame:
    """Pass a key once, ever. State grows with the number of keys; prefer `drop_repeats`."""
    return rows.dropDuplicates([key])


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write_batch(rows: DataFrame, target: str, batch: int, key: str | None = None) -> None:
    """Replace exactly the part of one batch, so a replayed batch changes nothing; the first column is the key if none is named."""
    laid = rows.withColumn("bucket", _bucket(key or rows.columns[0])).hint("rebalance", "bucket")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch_id={batch}")


def _log(spark: SparkSession, target: str, schema: T.StructType | str) -> DataFrame:
    """All rows of a target with the batch and the bucket they lie in."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    parts = [T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
    full = T.StructType([*fields.fields, *parts])
    if not files.exists(spark, target):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(target)


def _touched(batch: DataFrame, key: str) -> list[int]:
    """The buckets of a batch's keys, `BUCKETS` at most."""
    return [r[0] for r in batch.select(_bucket(key)).distinct().collect()]


def known_before(batch: DataFrame, target: str, schema: T.StructType | str, key: str, number: int) -> DataFrame:
    """Rows that earlier batches wrote into the buckets of this batch's keys; no other folder is read."""
    log = _log(batch.sparkSession, target, schema)
    return log.filter(F.col("bucket").isin(_touched(batch, key)) & (F.col("batch_id") < number)).drop("batch_id", "bucket")


def latest_buckets(
    spark: SparkSession, target: str, schema: T.StructType | str, buckets: list[int] | None = None, before: int | None = None,
) -> DataFrame:
    """The rows of the last batch that wrote each bucket: a keyed merge writes a bucket whole."""
    log = _log(spark, target, schema)
    log = log if buckets is None else log.filter(F.col("bucket").isin(buckets))
    log = log if before is None else log.filter(F.col("batch_id") < before)
    heads = log.groupBy("bucket").agg(F.max("batch_id").alias("head")).collect()  # a row per bucket
    last = functools.reduce(
        lambda a, r: a | ((F.col("bucket") == r["bucket"]) & (F.col("batch_id") == r["head"])), heads, F.lit(False))
    return log.filter(last).drop("batch_id", "bucket")


def append_new_keys(rows: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Incremental table: rows whose key no earlier batch wrote, one per key. Rows without key all pass."""
    schema = rows.schema

    def write(batch: DataFrame, number: int) -> None:
        known = known_before(batch, target, schema, key, number)
        new = recipes.new_keys(batch, known, key)
        # One row per key; its text decides, so a replayed batch keeps the same one.
        once = scale.first_per_key(new.filter(F.col(key).isNotNull()), [key], [F.to_json(F.struct("*"))])
        _write_batch(once.unionByName(new.filter(F.col(key).isNull())), target, number, key)

    return _each(rows, write, checkpoint)


def upsert_chunks(rows: DataFrame, target: str, checkpoint: str, offset: int = 0) -> StreamingQuery:
    """Merge batches into a vector table; `read_latest` gives the newest row per chunk.

    A batch rewrites the buckets of its chunks, as they were before it, with its own rows in place of theirs. Within a batch
    the highest `version` of a chunk wins. A stream with a new checkpoint counts its batches from 0 again:
    `offset` is the number of batches already written. `compact` removes what later batches have replaced.
    """
    def write(batch: DataFrame, number: int) -> None:
        usable = batch.filter(F.size("embedding") > 0)
        newest = scale.settle(scale.first_per_key(usable, ["chunk_id"], [F.desc("version")]).drop("version"), "newest")
        known = latest_buckets(batch.sparkSession, target, newest.schema, _touched(newest, "chunk_id"), offset + number)
        kept = known.join(newest.select("chunk_id"), "chunk_id", "left_anti").select(*newest.columns)
        _write_batch(kept.unionByName(newest), target, offset + number, "chunk_id")

    return _each(rows, write, checkpoint)


def read_latest(spark: SparkSession, target: str, schema=schemas.CHUNKS) -> DataFrame:
    return latest_buckets(spark, target, schema)


def _each(rows: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_totals(logs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calories and meals per member and event-time day; rows later than `delay` are dropped."""
    return (
        logs.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "username")
        .agg(F.sum(KCAL).alias("total_kcal"), F.count("recipe_name").alias("meal_count"))
        .select("username", F.to_date("w.start").alias("date"), "total_kcal", "meal_count")
    )


def weekly_means(logs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean kcal per meal over seven-day windows sliding by a day, named by their last day."""
    return (
        logs.withWatermark("ts", delay)
        .groupBy(F.window("ts", "7 days", "1 day").alias("w"), "username")
        .agg(F.avg(KCAL).alias("avg_kcal"), F.count(F.lit(1)).alias("rows"))
        .select("username", F.date_sub(F.to_date("w.end"), 1).alias("week_end"), "avg_kcal", "rows")
    )


def write_windows(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Log every batch's new totals of the windows it touched, open ones too; see `read_windows`."""
    return (
        rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: _write_batch(batch, target, number))
        .trigger(availableNow=True).start()
    )


def read_windows(spark: SparkSession, target: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The latest total of each window, whether it is closed or not."""
    log = _log(spark, target, schema)
    return scale.first_per_key(log, keys, [F.desc("batch_id")]).drop("batch_id", "bucket")


def compact(spark: SparkSession, target: str, keys: list[str], schema=schemas.CHUNKS) -> None:
    """Replace the log of a target by one batch with the newest row per key, under the last batch's number.

    Run it between two streams, not beside one.
    """
    log = _log(spark, target, schema)
    last = log.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    kept = scale.settle(scale.first_per_key(log, keys, [F.desc("batch_id")]).drop("batch_id", "bucket"), "compacted")
    old = [row[0] for row in log.select("batch_id").distinct().collect() if row[0] != last]
    _write_batch(kept, target, last)
    for number in old:
        scratch.remove(spark, f"{target}/batch_id={number}")


def write_closed_windows(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each window once the watermark has passed it."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    )
