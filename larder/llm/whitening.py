"""Whitening of vectors with distributed block matrices.

Rows are centred exactly, in whole numbers, and put into blocks of rows; the blocks, numbered, are a `BlockMatrix`. Its
transpose times itself is the scatter, whose eigenvectors are found on the driver, as it has as many entries as there
are pairs of dimensions. Another block product, with the whitening matrix, projects all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.rdd import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.components import forget, keep

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Rows of a block; with more than `MANY` blocks they get larger, as the driver holds the blocks' numbers.
ROWS = 256
MANY = 50_000
#: Blocks that meet in one task of the scatter product.
TOGETHER = 32
_LONG = 2**63 - 1
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_BLOCK = "ids array<long>, deviations array<long>, centred binary"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift of the vectors without a null or non-finite entry."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    return vectors.where(v.isNotNull() & whole & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of `size` rows x - sums / n, the last of a task filled up with rows of zeros; n * x - sums is worked out in whole numbers."""
    total = np.array(sums, object)
    reach = max(map(abs, sums), default=0)

    def block(ids: list, far: list, rows: list) -> pa.RecordBatch:
        whole = np.zeros((size, len(sums)))
        whole[: len(rows)] = rows
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([far], pa.list_(pa.int64())), pa.array([whole.tobytes()], pa.binary())],
            ["ids", "deviations", "centred"])

    ids, far, rows = [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        top = max(abs(int(x.max())), abs(int(x.min())))
        if n * top + reach < _LONG:
            apart = n * x - total.astype(np.int64)
        else:
            apart = n * x.astype(object) - total
        if with_ids:
            widest = max(abs(int(apart.max())), abs(int(apart.min())))
            exact = apart if widest * widest * len(sums) < _LONG else apart.astype(object)
            far += [d if d <= _LONG else None for d in (exact * exact).sum(axis=1).tolist()]
            ids += batch.column("vec_id").to_pylist()
        rows.extend((apart / n).astype(float))
        while len(rows) >= size:
            yield block(ids[:size], far[:size], rows[:size])
            ids, far, rows = ids[size:], far[size:], rows[size:]
    if rows:
        yield block(ids, far, rows)


def _numbered(blocks: DataFrame) -> RDD:
    """(number, row) of the blocks; they are read from a written table, so a lost task numbers them alike."""
    return blocks.rdd.zipWithIndex().map(lambda pair: (pair[1], pair[0]))


def _matrix(numbered: RDD, size: int, width: int) -> BlockMatrix:
    blocks = numbered.map(lambda pair: ((pair[0], 0), DenseMatrix(size, width, np.frombuffer(pair[1].centred, np.float64), True)))
    return BlockMatrix(blocks, size, width)


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """Transpose times matrix."""
    turned = matrix.transpose()
    # The Scala method's second argument, which Python's lacks: in how many tasks the products of blocks are summed up.
    splits = math.ceil(blocks / TOGETHER)
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _once(spark: SparkSession, values: np.ndarray) -> BlockMatrix:
    height, width = values.shape
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(height, width, values.ravel(), True))], 1), height, width)


def _rows(batches: Iterator[pa.RecordBatch], shares: list[float]) -> Iterator[pa.RecordBatch]:
    """One row per vector and component of each projected block."""
    k = len(shares)
    for batch in batches:
        for ids, far, values in zip(batch.column("ids"), batch.column("deviations"), batch.column("values"), strict=True):
            count = len(ids.values)
            out = np.frombuffer(values.as_buffer(), np.float64).reshape(-1, k)[:count]
            take = pa.array(np.repeat(np.arange(count), k))
            yield pa.RecordBatch.from_arrays(
                [ids.values.take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), far.values.take(take),
                 pa.array(out.ravel()), pa.array(np.tile(shares, count))],
                ["vec_id", "component", "deviation", "whitened", "explained"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Vectors projected on the leading components of their covariance, each scaled to variance one.

    Entries become x = floor(scale * entry) + shift. Mean and covariance (divisor n) are those of the n distinct x vectors.
    Returns per vector and component: vec_id, component (from 1, by falling variance), n, deviation (sum over
    dimensions of (n * x - sums) ** 2, exact), whitened, explained (share of the whole variance), identity_error (largest
    absolute entry of the distinct vectors' whitened covariance minus the identity).

    Null and empty vectors and those with a null or non-finite entry are left out, and so are vectors of another length
    than the most frequent (the shorter of equally frequent ones): they have no place in the covariance.
    Components without variance, beyond rounding, are left out, so an empty table, a single or always the same vector give
    an empty result. Rows may share an id or have none. Scaled entries beyond 64 bits count as the nearest 64-bit
    number; a deviation beyond 63 bits is null. Sums, scatter and eigenvectors, of the size of the dimensions, are all
    that comes to the driver.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale, shift)
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not width:
        return spark.createDataFrame([], _RESULT)
    width = width[0].width
    rows = rows.where(F.size("x") == width)
    fit = keep(rows.select("x").distinct(), "fit")
    first = fit.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]).first()
    n, sums = first.n, [int(s) for s in first[1:]]

    def blocks(table: DataFrame, size: int, with_ids: bool, name: str) -> DataFrame:
        return keep(table.mapInArrow(lambda parts: _blocks(parts, n, sums, size, with_ids), _BLOCK), name)

    size = max(ROWS, 1 << math.ceil(math.log2(max(1, n / MANY))))
    cut = blocks(fit, size, False, "fit-blocks")
    forget(fit)
    count = cut.count()
    matrix = _matrix(_numbered(cut), size, width)
    covariance = _scatter(matrix, count) / n
    values, turned = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    leading = [i for i in np.argsort(-values)[:components] if values[i] > trace * width * np.finfo(float).eps]
    if not leading:
        return spark.createDataFrame([], _RESULT)
    whitening = _once(spark, turned[:, leading] / np.sqrt(values[leading]))
    error = float(np.abs(_scatter(matrix.multiply(whitening), count) / n - np.eye(len(leading))).max())

    total = rows.count()
    size = max(ROWS, 1 << math.ceil(math.log2(max(1, total / MANY))))
    numbered = _numbered(blocks(rows, size, True, "row-blocks"))
    projected = _matrix(numbered, size, width).multiply(whitening).blocks
    projected = spark.createDataFrame(
        projected.map(lambda pair: (pair[0][0], bytearray(pair[1].toArray().tobytes()))), "block long, values binary")
    known = spark.createDataFrame(
        numbered.map(lambda pair: (pair[0], pair[1].ids, pair[1].deviations)), "block long, ids array<long>, deviations array<long>")
    shares = [float(values[i] / trace) for i in leading]
    out = known.join(projected, "block").select("ids", "deviations", "values").mapInArrow(
        lambda parts: _rows(parts, shares), "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
