"""Building blocks that keep hot groups out of single tasks."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.sources import scratch

def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    What follows neither repeats the work nor depends on the executors that did it, and the
    size of the written table, which is known, decides how it is joined.
    """
    path = scratch.new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """A table of files dealt out to tasks of about `rows` rows, whatever pieces the files can be read in.

    For tables whose rows grow in the next step. Blocks of rows that follow one another stay together, as rows of one key
    often do; keys play no part, so none can be hot. A table with no more than `rows` rows is left as it is.
    """
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df
    block = F.shiftright(F.monotonically_increasing_id(), 10)
    return df.withColumn("_block", block).repartition(parts, "_block").drop("_block")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First `k` rows per key.

    Up to `spark.sql.optimizer.windowGroupLimitThreshold` rows (1000 by default) Catalyst turns the
    filtered `row_number` into a group limit on both sides of the shuffle, so a hot key
    sends at most `k` rows per input task; with a larger `k` all its rows are sorted.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Like `first_per_key`, keeping the rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def _matches(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality on all `names`, where NULL equals NULL."""
    return functools.reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def _sum_before(
    df: DataFrame, keys: list[str], order: Sequence[str], value: str, buckets: Sequence[Column], out: str
) -> DataFrame:
    """Sum of `value` over the rows of the key ahead of each; NULL where there is none."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not buckets:
        return df.withColumn(out, F.sum(value).over(ahead))
    names = [f"_b{len(buckets)}_{i}" for i in range(len(buckets))]
    rows = df.select("*", *(b.alias(n) for b, n in zip(buckets, names)))
    totals = rows.groupBy(*keys, *names).agg(F.sum(value).alias("_total"))
    totals = _sum_before(totals, keys, [names[0]], "_total", [F.col(n) for n in names[1:]], "_before")
    totals = totals.select(*keys, names[0], "_before")
    ahead = Window.partitionBy(*keys, names[0]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.sum(value).over(ahead))
    joined = rows.join(totals, _matches(rows, totals, [*keys, names[0]]))
    return joined.select(*(rows[c] for c in df.columns), _plus("_before", "_inside").alias(out))


def _plus(a: str, b: str) -> Column:
    """Sum of two columns, a NULL counting as nothing unless both are."""
    return F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
    buckets: Sequence[Column], out: str,
) -> DataFrame:
    """Inclusive running sum of `value` per key, without sorting a whole key in one task.

    `buckets` are Columns, finest first, that never decrease along `order`, each constant
    within the next finer one. Rows are summed inside (key, bucket) only; what comes
    before a bucket is the running sum of the bucket totals, found the same way one level up.
    A NULL key is a key of its own, and rows with a NULL in the order come first.
    """
    rows = _sum_before(df, list(keys), order, value, buckets, "_ahead")
    return rows.withColumn(out, _plus("_ahead", value)).drop("_ahead")


def concat_ordered(
    df: DataFrame, keys: Sequence[str], position: str, text: str, sep: str = "\n\n", span: int = 1024,
    out: str = "text", totals: Sequence[str] = (),
) -> DataFrame:
    """Join all texts of a key in order of a whole-number position, unique within the key, into one.

    Positions are joined in segments of `span` first, each in a task of its own, so only the
    segments' texts meet in the task that writes the key's text. Columns in `totals` are summed
    up. Rows without text are left out; a NULL position comes first.
    """
    row = F.struct(F.col(position).alias("p"), F.col(text).alias("t"))
    segments = (
        df.filter(F.col(text).isNotNull())
        .groupBy(*keys, F.floor(F.col(position) / span).cast("long").alias("_segment"))
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["t"]), sep).alias("_text"),
            F.count(F.lit(1)).alias("_parts"), *(F.sum(c).alias(c) for c in totals),
        )
    )
    whole = F.sort_array(F.collect_list(F.struct("_segment", "_text")))
    return segments.groupBy(*keys).agg(
        F.array_join(F.transform(whole, lambda r: r["_text"]), sep).alias(out),
        F.sum("_parts").alias("parts"), *(F.sum(c).alias(c) for c in totals),
    )
