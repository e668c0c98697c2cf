"""Exact vector search, plain and through an index of cells, and keyed upserts over a chunk table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.functions import text
from larder.operators import scale

TOP_K = 15
SUMMARY_K = 50
# Centroids are fitted on so many numbers at most, a seeded choice of whole vectors, and there are so many at most.
SAMPLE_NUMBERS = 8_000_000
MOST_CELLS = 1_024
FIT_ROUNDS = 8
# Rounding must not hide a cell.
MARGIN = 1e-6


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def similarity(a: Column, b: Column, metric: str = "cosine", b_norm: Column | None = None) -> Column:
    """Score of two vectors, larger is closer; unequal dimensions are an error.

    `b_norm` is the length of `b` where it is known, so it is not worked out per row.
    """
    if metric == "dot":
        score = _dot(a, b)
    elif metric == "l2":
        score = -F.sqrt(F.aggregate(
            F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)),
            F.lit(0.0), lambda acc, p: acc + p,
        ))
    elif metric == "cosine":
        score = F.try_divide(_dot(a, b), norm(a) * (norm(b) if b_norm is None else b_norm))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(a) == F.size(b), score).otherwise(
        F.raise_error(F.lit("vectors differ in dimension")).cast("double")
    )


def top_k(
    vectors: DataFrame, query: Sequence[float], conditions: Sequence[str] | None = None, k: int = TOP_K,
    metric: str = "cosine",
) -> DataFrame:
    """The `k` closest chunks of the given conditions; one scan, one bounded top-k per task."""
    kept = vectors if conditions is None else vectors.filter(F.col("condition").isin(list(conditions)))
    point = F.array(*(F.lit(float(x)) for x in query))
    length = F.lit(math.sqrt(sum(float(x) ** 2 for x in query)))
    scored = kept.withColumn("score", similarity(F.col("embedding"), point, metric, length))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def top_k_per_condition(
    vectors: DataFrame, queries: DataFrame, k: int = TOP_K, metric: str = "cosine"
) -> DataFrame:
    """The same for one query vector per condition: every chunk is scored once."""
    sized = queries.select("condition", "query", norm(F.col("query")).alias("query_norm"))
    scored = vectors.join(sized, "condition").withColumn(
        "score", similarity(F.col("embedding"), F.col("query"), metric, F.col("query_norm"))
    ).drop("query", "query_norm")
    return scale.ranked(scored, ["condition"], [F.desc("score"), F.col("chunk_id")], k)


def _fit(points: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of a sample: Lloyd's rounds from spread-out points."""
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centroids = points[chosen]
    for _ in range(FIT_ROUNDS):
        near = _nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(counts > 0, sums / np.maximum(counts, 1), centroids)
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * points @ centroids.T).argmin(axis=1)


def write_index(vectors: DataFrame, path: str, cells: int = 256, metric: str = "cosine", seed: int = 1) -> None:
    """Vectors laid out by cell, so that a search opens only the cells that can hold an answer.

    Centroids are fitted on a seeded sample of `SAMPLE_NUMBERS` numbers; every vector goes to its nearest one,
    under `cosine` by its direction. Beside the vectors lies a row per cell: count, centroid, and the largest distance
    of its vectors from the centroid. Vectors without a direction have a cell of their own.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    order = text.seeded_order(seed, F.col("chunk_id").cast("string"))
    taken = vectors.select("embedding", order.alias("o")).orderBy("o").limit(max(1, SAMPLE_NUMBERS // width)).collect()
    points = np.array([r.embedding for r in taken], dtype=float).reshape(len(taken), width)
    unit = metric == "cosine"

    def directed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.sqrt((rows**2).sum(axis=1))
        return (rows / np.maximum(length, 1e-300)[:, None] if unit else rows), length

    centroids = _fit(directed(points)[0], min(cells, MOST_CELLS)) if len(points) else np.zeros((1, width))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
            rows, length = directed(rows.reshape(batch.num_rows, width))
            near = ((centroids**2).sum(axis=1)[None, :] - 2 * rows @ centroids.T).argmin(axis=1)
            away = np.sqrt(((rows - centroids[near]) ** 2).sum(axis=1))
            if unit:
                near = np.where(length > 0, near, -1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    laid = vectors.mapInArrow(placed, f"{kinds}, cell int, away double")
    # A crowded cell is written by several tasks.
    laid.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    laid.limit(0).write.mode("overwrite").parquet(f"{path}/layout")  # what the columns are, if there are no vectors
    found = spark.read.schema(laid.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    middles = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    found.join(middles, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


@dataclass
class Index:
    """An index on disk and what is known of its cells, which is as much as they are."""

    spark: SparkSession
    path: str
    metric: str = "cosine"

    def __post_init__(self) -> None:
        rows = self.spark.read.parquet(f"{self.path}/cells").collect()
        self.layout = self.spark.read.parquet(f"{self.path}/layout").schema
        self.known = {r.cell: (r.n, r.radius, np.array(r.centroid) if r.centroid is not None else None) for r in rows}

    def best_possible(self, query: Sequence[float]) -> dict[int, float]:
        """Per cell a score that none of its vectors exceeds."""
        q = np.array(query, float)
        length = float(np.sqrt((q**2).sum()))
        out = {}
        for cell, (_, radius, centroid) in self.known.items():
            if cell < 0 or (self.metric == "cosine" and not length):
                out[cell] = -math.inf
            elif self.metric == "dot":
                out[cell] = float(q @ centroid) + length * radius
            else:
                at = q / length if self.metric == "cosine" else q
                gap = max(0.0, float(np.sqrt(((at - centroid) ** 2).sum())) - radius)
                out[cell] = 1 - gap * gap / 2 if self.metric == "cosine" else -gap
        return out

    def scanned(self, cells: Sequence[int]) -> int:
        return sum(self.known[c][0] for c in cells)

    def cells_for(self, query: Sequence[float], conditions: Sequence[str] | None = None, k: int = TOP_K) -> list[int]:
        """The cells that can hold one of the `k` closest chunks: the most promising are searched, and their worst answer rules others out."""
        best = self.best_possible(query)
        order = sorted(best, key=lambda c: (-best[c], c))
        first = []
        while len(first) < len(order) and self.scanned(first) < 2 * k:
            first.append(order[len(first)])
        scores = [r.score for r in self._top(query, first, conditions, k).select("score").collect() if r.score is not None]
        if len(scores) < k:
            return order
        worst = min(scores)
        return [c for c in order if c in first or best[c] >= worst - MARGIN * max(1.0, abs(worst))]

    def _top(self, query: Sequence[float], cells: Sequence[int], conditions: Sequence[str] | None, k: int) -> DataFrame:
        rows = self.spark.read.schema(self.layout).parquet(f"{self.path}/vectors").filter(F.col("cell").isin(list(cells)))
        return top_k(rows.drop("cell", "away"), query, conditions, k, self.metric)

    def top_k(self, query: Sequence[float], conditions: Sequence[str] | None = None, k: int = TOP_K) -> DataFrame:
        """What `top_k` finds in all vectors, from the cells that matter."""
        return self._top(query, self.cells_for(query, conditions, k), conditions, k)


def upsert(
    table: DataFrame, batch: DataFrame, version: str = "version", replace_document: bool = False
) -> DataFrame:
    """Table after a batch: the newest version per chunk id wins, empty vectors are skipped.

    `replace_document` first drops all chunks of the batch's source files, so a document
    that shrank leaves no old tail. Only the batch is ranked; the table is anti-joined with
    its keys, without a shuffle while they are few.
    """
    usable = batch.filter(F.size("embedding") > 0)
    newest = scale.settle(scale.first_per_key(usable, ["chunk_id"], [F.desc(version)]), "newest")
    key = "source_file" if replace_document else "chunk_id"
    changed = newest.select(key).distinct()
    kept = table.join(changed, key, "left_anti")
    return kept.unionByName(newest.select(*table.columns))
