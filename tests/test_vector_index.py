"""The index of cells against the plain search over all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import vectors

SCHEMA = "chunk_id string, embedding array<float>, condition string"


def clustered(n, width, middles, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(middles, width))
    return [(f"c{i:05}", [float(x) for x in centre[i % middles] + rng.normal(size=width) * spread], f"k{i % 3}") for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_equals_the_plain_search(spark, tmp_path, metric):
    rows = clustered(600, 8, 7, 0.4, 1)
    rows += [("z1", [0.0] * 8, "k0"), ("z2", [0.0] * 8, "k1"), ("same", rows[5][1], "k2")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    vectors.write_index(frame, str(tmp_path / "i"), 9, metric)
    index = vectors.Index(spark, str(tmp_path / "i"), metric)
    rng = np.random.default_rng(2)
    for query in [rows[3][1], [float(x) for x in rng.normal(size=8) * 3], [0.0] * 8]:
        for conditions, k in [(None, 15), (["k1", "k2"], 4), (["k0"], 500), (["none"], 3)]:
            show = lambda f: [(r.chunk_id, r.score and round(r.score, 9)) for r in f.collect()]
            assert show(index.top_k(query, conditions, k)) == show(vectors.top_k(frame, query, conditions, k, metric))


def test_few_vectors_of_1536_dimensions_are_scored(spark, tmp_path):
    frame = spark.createDataFrame(clustered(3_000, 1536, 12, 0.3, 3), SCHEMA)
    vectors.write_index(frame, str(tmp_path / "i"), 12)
    index = vectors.Index(spark, str(tmp_path / "i"))
    query = clustered(1, 1536, 12, 0.3, 3)[0][1]
    found = index.top_k(query)
    assert index.scanned(index.cells_for(query)) < 1_000
    assert [r.chunk_id for r in found.collect()] == [r.chunk_id for r in vectors.top_k(frame, query).collect()]
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_empty_and_tiny_tables(spark, tmp_path):
    frame = spark.createDataFrame([], SCHEMA)
    vectors.write_index(frame, str(tmp_path / "none"))
    assert vectors.Index(spark, str(tmp_path / "none")).top_k([1.0]).count() == 0
    frame = spark.createDataFrame([("a", [1.0, 0.0], "k"), ("b", [1.0, 0.0], "k")], SCHEMA)
    vectors.write_index(frame, str(tmp_path / "two"))
    assert [r.chunk_id for r in vectors.Index(spark, str(tmp_path / "two")).top_k([1.0, 1.0]).orderBy("chunk_id").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="metric"):
        vectors.write_index(frame.select("*", F.lit(1).alias("x")), str(tmp_path / "bad"), metric="taxi")
