"""Exact k-means over integer vectors with the Shallot search.

Every vector carries four things from round to round: its centroid, the second-nearest one, an upper bound on
the distance to the first and a lower bound on the distance to any other. The bounds drift with the moves of the
centroids; while they stay apart no distance is worked out. Where they meet, both remembered centroids are
measured, and the search starts from the closer one: its neighbours come in order of their distance from it, inside a
ball of its distance plus the second-best distance so far, which shrinks with each find. Bounds are floating point with a
margin; survivors are compared as integers, so the result is that of comparing with every centroid.

All vectors of a batch go through the search in step, one neighbour a step. Vectors are never shuffled: a round
rewrites them with their bounds, and only the sums of those that changed sides travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import forget, keep

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
#: Relative margin of the bounds; doubles err by 1e-15 or so.
MARGIN = 1e-9
#: Below this, differences, squares and their sums stay inside 64 bits for up to 128 components.
_SMALL = 1 << 27
_LONG = 2**63 - 1
_STATE = "vec_id long, x array<long>, near int, second int, upper double, lower double, was int"


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers if sums of squares fit, else as Python's integers."""
    small = all(a.size == 0 or max(abs(int(a.max())), abs(int(a.min()))) < _SMALL for a in arrays)
    return [a.astype(np.int64 if small else object) for a in arrays]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of every row of `x` to that row of `y`."""
    difference = x - y
    return (difference * difference).sum(axis=1)


class Centres:
    """Centroids with the order and distances of each one's neighbours."""

    def __init__(self, points: list[tuple[int, ...]]):
        self.points = np.array(points, dtype=object).reshape(len(points), -1)
        k = len(points)
        apart = np.zeros((k, k))
        for i in range(k):
            apart[i] = np.sqrt(squares(self.points, self.points[i]).astype(float))
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:].astype(np.int32)
        self.gaps = np.take_along_axis(apart, self.order, axis=1)
        #: A vector nearer than this has no nearer centroid.
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.drift = np.zeros(k)

    def moved_from(self, before: Centres) -> Centres:
        self.drift = np.sqrt(squares(self.points, before.points).astype(float))
        return self

    def others_drift(self) -> np.ndarray:
        """Per centroid, the longest way that any other one has moved."""
        if len(self.drift) < 2:
            return np.zeros(len(self.drift))
        first, second = np.sort(self.drift)[::-1][:2]
        out = np.full(len(self.drift), first)
        out[int(np.argmax(self.drift))] = second
        return out


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
           centres: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(near, second, upper, lower) of the vectors after the centroids' move, and the number of distances worked out.

    Ties go to the smaller number. Unplaced vectors have near = -1.
    """
    x, points = _exact(x, centres.points)
    near, second, upper, lower = near.copy(), second.copy(), upper.copy(), lower.copy()
    if len(points) == 1:
        near[:], second[:], upper[:], lower[:] = 0, -1, np.inf, np.inf
        return near, second, upper, lower, 0
    new = near < 0
    near[new], second[new], upper[new], lower[new] = 0, 1, np.inf, 0.0
    upper = (upper + centres.drift[near]) * (1 + MARGIN)
    lower = np.maximum(0.0, lower - centres.others_drift()[near]) * (1 - MARGIN)

    def unsure(rows: np.ndarray) -> np.ndarray:
        return rows[upper[rows] >= np.maximum(lower[rows], centres.half[near[rows]]) * (1 - MARGIN)]

    rows = unsure(np.arange(len(x)))
    one = squares(x[rows], points[near[rows]])
    counted = len(rows)
    upper[rows] = np.sqrt(one.astype(float)) * (1 + MARGIN)
    left = unsure(rows)
    one, rows = one[np.isin(rows, left, assume_unique=True)], left
    two = squares(x[rows], points[second[rows]])
    counted += len(rows)
    a, b = near[rows], second[rows]
    swap = (two < one) | ((two == one) & (b < a))
    a, b, one, two = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, two, one), np.where(swap, one, two)
    start, other = a.copy(), b.copy()
    reach = np.sqrt(one.astype(float))
    at = np.arange(len(rows))
    for step in range(len(points) - 1):
        ball = (reach[at] + np.sqrt(two[at].astype(float))) * (1 + MARGIN)
        at = at[centres.gaps[start[at], step] <= ball]
        if not len(at):
            break
        found = centres.order[start[at], step]
        fresh = found != other[at]
        here, found = at[fresh], found[fresh]
        d = squares(x[rows[here]], points[found])
        counted += len(here)
        first = (d < one[here]) | ((d == one[here]) & (found < a[here]))
        i, c = here[first], found[first]
        b[i], two[i], a[i], one[i] = a[i], one[i], c, d[first]
        i, c, e = here[~first], found[~first], d[~first]
        next_ = (e < two[i]) | ((e == two[i]) & (c < b[i]))
        b[i[next_]], two[i[next_]] = c[next_], e[next_]
    near[rows], second[rows] = a, b
    upper[rows] = np.sqrt(one.astype(float)) * (1 + MARGIN)
    lower[rows] = np.sqrt(two.astype(float)) * (1 - MARGIN)
    return near, second, upper, lower, counted


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _placed(batches: Iterator[pa.RecordBatch], centres: Centres) -> Iterator[pa.RecordBatch]:
    """The vectors with their new centroids and bounds; `was` is the centroid before."""
    for batch in batches:
        if not batch.num_rows:
            continue
        old = [batch.column(c).to_numpy() for c in ("near", "second", "upper", "lower")]
        *new, _ = search(_vectors(batch), *old, centres)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("x"), *(pa.array(c) for c in new), pa.array(old[0])],
            ["vec_id", "x", "near", "second", "upper", "lower", "was"])


def _changes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per centroid what its sums (and last its count) gain and lose by the vectors that changed sides, once per task."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, = _exact(_vectors(batch))
        x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
        if total is None:
            total = np.zeros((k, x.shape[1]), object)
        part = np.zeros((k, x.shape[1]), x.dtype)
        np.add.at(part, batch.column("near").to_numpy(), x)
        was = batch.column("was").to_numpy()
        np.subtract.at(part, was[was >= 0], x[was >= 0])
        total += part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array([[Decimal(int(v)) for v in row] for row in total], pa.list_(pa.decimal128(38, 0)))],
            ["cluster", "sums"])


def _distances(batches: Iterator[pa.RecordBatch], centres: Centres) -> Iterator[pa.RecordBatch]:
    """The final centroid of each vector and the exact squared distance, null beyond 63 bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _vectors(batch)
        near, *_ = search(x, *[batch.column(c).to_numpy() for c in ("near", "second", "upper", "lower")], centres)
        x, points = _exact(x, centres.points)
        d = [v if v <= _LONG else None for v in squares(x, points[near]).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dimensions: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that have all their components, each a finite number."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(v.isNotNull() & (F.size(v) == dimensions) & whole).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """Exact k-means; per kept vector vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of `dimensions` finite components become integers floor(scale * component). The first centroids are the
    `k` vectors whose sha256 of `seed:vec_id` is smallest. `rounds` times all vectors go to the nearest
    centroid (ties: the smaller number) and every centroid with vectors becomes their componentwise floor(mean); then they
    are assigned once more. All of it is exact.

    Null vectors and those with another length, a null or a non-finite component are left out. A null id stands behind
    all others in the order of the first centroids; rows that share an id are separate and stand in the order of their vectors. With
    fewer than `k` vectors all are centroids; an empty table gives an empty result. Scaled components beyond
    64 bits count as the nearest 64-bit number; a squared distance or inertia beyond 63 bits is null. Only the `k`
    centroids and their sums come to the driver.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale, dimensions)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    points = [tuple(r.x) for r in rows.orderBy(name.asc_nulls_last(), "x").limit(k).collect()]
    k = len(points)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = rows.selectExpr("vec_id", "x", "-1 near", "-1 second", "0D upper", "0D lower")
    centres, totals = Centres(points), [[0] * (dimensions + 1) for _ in range(k)]
    for number in range(rounds):
        before = state
        state = keep(before.mapInArrow(lambda parts, c=centres: _placed(parts, c), _STATE), "placed")
        if number:
            forget(before)
        changed = state.where("near <> was").mapInArrow(lambda parts: _changes(parts, k), "cluster int, sums array<decimal(38,0)>")
        changed = changed.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("gain"))
        for r in changed.collect():  # k sums of `dimensions` numbers
            totals[r.cluster][r.pos] += int(r.gain)
        points = [tuple(s // t[-1] for s in t[:-1]) if t[-1] else p for t, p in zip(totals, points, strict=True)]
        centres = Centres(points).moved_from(centres)
    last = keep(state.mapInArrow(lambda parts: _distances(parts, centres), "vec_id long, cluster int, distance long"), "distances")
    if rounds:
        forget(state)

    digests = [(i, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for i, p in enumerate(points)]
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    unknown = F.max(F.col("distance").isNull())
    sums = last.groupBy("cluster").agg(wide.alias("s"), unknown.alias("u")).collect()  # k rows
    total = sum(int(r.s or 0) for r in sums)
    known = not any(r.u for r in sums) and total <= _LONG
    each = {r.cluster: None if r.u or int(r.s) > _LONG else int(r.s) for r in sums}
    named = spark.createDataFrame(
        [(i, each.get(i), total if known else None, d) for i, d in digests],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(table: str = "embeddings", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 2) -> str:
    """The query's result in SQL: every vector is compared with every centroid in each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select r, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance
  from (select v.r, c.cluster, cast(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c.x)]) as bigint) as d
        from v cross join c{i} as c) as pairs group by r)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} as materialized (
  select c.cluster, coalesce(m.x, c.x) as x
  from c{i} as c left join (
    select cluster, list(mean order by pos) as x
    from (select cluster, pos, cast(floor(sum(value) / count(*)) as bigint) as mean
          from (select a.cluster, unnest(v.x) as value, generate_subscripts(v.x, 1) as pos from a{i} as a join v on a.r = v.r) as u
          group by cluster, pos) as means group by cluster) as m on c.cluster = m.cluster)""")
    return f"""
with v as materialized (
  select row_number() over (order by vec_id) as r, vec_id,
    [cast(floor({scale} * cast(e as double)) as bigint) for e in embedding] as x
  from {table}
  where len(embedding) = {dimensions} and len([e for e in embedding if e is null or isnan(e) or isinf(e)]) = 0),
c0 as materialized (
  select row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 as cluster, x from v
  qualify row_number() over (order by sha256('{seed}:' || vec_id), x) <= {k}),{",".join(steps)}
select v.vec_id, cast(a.cluster as integer) as cluster, a.distance,
  cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} as a join v on a.r = v.r join c{rounds} as c on a.cluster = c.cluster"""
