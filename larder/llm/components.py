"""Connected components of a table of links, by union-find per partition and star rounds between them."""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources import scratch


#: Spark then drops a statement's shuffle files when it ends; nothing reads them once its result is written.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[dict[str, tuple[str, SparkSession]]] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch.new_dir(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    for scope in _scopes:
        scope[path] = (name, spark)
    return kept


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of every statement are dropped when it ends; for statements that write a table."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def forget(*kept: DataFrame) -> None:
    """Delete tables made by `keep` that nothing reads any more."""
    for df in kept:
        path = _paths.pop(df)
        for scope in _scopes:
            scope.pop(path, None)
        scratch.remove(df.sparkSession, path)


@contextmanager
def only(*names: str) -> Iterator[None]:
    """Tables that `keep` makes inside are deleted at the end, but for those of the given names."""
    made: dict[str, tuple[str, SparkSession]] = {}
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not made]
        for path, (name, spark) in made.items():
            if name not in names:
                scratch.remove(spark, path)


#: A table of keys with at most so many rows is sent to all tasks, so that texts need not travel to it.
BROADCAST_ROWS = 500_000


def handy(kept: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table made by `keep`, to be joined with texts: sent to every task if it is small, else left to Spark's choice."""
    return F.broadcast(kept) if kept.count() <= rows else kept


def bounded_sample(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """At most `size` rows, the first in the order of a hash of `keys`; the same rows whatever their order.

    Only rows below a bound of the hash, about twice as many as wanted, are sorted and sent anywhere.
    """
    share = min(1.0, (2 * size + 1000) / max(1, rows.count()))
    place = F.xxhash64(*keys)
    return rows.where(place <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy(place, *keys).limit(size)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long); root is the smallest node it reaches.

    Each partition first replaces its links by those of its own union-find forest. Then rounds of the
    large-star and small-star steps join every node to the smallest neighbour known until nothing
    changes; the number of rounds is logarithmic. Each round is an aggregation and a join on nodes;
    nothing is gathered in one place. Links of a node to itself give it a row of its own; nulls are not nodes.
    """
    spark = links.sparkSession
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    edges = keep(edges.mapInPandas(_local_forest, "a long, b long").distinct(), "links")
    mark = _mark(edges)
    while True:
        before = edges
        edges = keep(_small_star(_large_star(edges)), "stars")
        forget(before)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.where("node <> root").unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _local_forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (node, root) of the forest over each batch's links."""
    for part in parts:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour of that node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a or a = b").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
