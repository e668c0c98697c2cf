import random

import numpy as np
import pytest

from larder.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, ids string"


def brute(rows, components):
    """(sorted (id, deviation, absolute projections), shares) with numpy over all rows at once."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s) / n).astype(float)
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    lead = np.argsort(-values)[:components]
    out = ((n * x - s) / n).astype(float) @ (turned[:, lead] / np.sqrt(values[lead]))
    return n, ((n * x - s) ** 2).sum(axis=1), out, values[lead] / values.sum(), kept


@pytest.mark.parametrize(("dimensions", "components"), [(20, 16), (6, 16), (5, 2)])
def test_equals_numpy(spark, dimensions, components):
    rng = np.random.default_rng(dimensions)
    mix = rng.normal(size=(dimensions, dimensions))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(700, dimensions)) @ mix)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(5, rows[1][1]), (None, rows[2][1])]
    odd = [(2000, None), (2001, [None] * dimensions), (2002, [float("nan")] + [0.0] * (dimensions - 1)), (2003, [float("-inf")] * dimensions)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, *odd, (2004, [1.0]), (2005, [])]], SCHEMA).repartition(5)
    got = whitening.whiten(frame, components=components).collect()
    n, far, out, shares, kept = brute(rows, components)
    k = min(dimensions, components)
    assert len(got) == len(kept) * k and all(r.n == n and r.identity_error < 1e-9 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = {}
    for (i, _), d, p in zip(kept, far, out, strict=True):
        mine = by_id[(i, d)]
        for c in range(k):
            assert abs(mine[c + 1].explained - shares[c]) < 1e-9
            assert abs(abs(mine[c + 1].whitened) - abs(p[c])) < 1e-7
            if abs(p[c]) > 1e-3:
                signs.setdefault(c, set()).add(mine[c + 1].whitened * p[c] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_large_numbers_and_degenerate_tables(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 1e13))), float(np.float32(rng.gauss(0, 1e13)))]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()
    n, far, out, _, _ = brute(rows, 2)
    assert [r.deviation for r in sorted(got, key=lambda r: (r.vec_id, r.component)) if r.component == 1] == [
        d if d < 2**63 else None for d in far]
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        frame = whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA))
        assert frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and frame.count() == 0
    flat = spark.createDataFrame([(i, [float(i), 3.0], 1, "x") for i in range(9)], SCHEMA)  # one dimension does not vary
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in got)
