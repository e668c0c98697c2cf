import hashlib
import random

import numpy as np
import pytest

from larder.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, near string, x int"


def brute(rows, k, rounds, dimensions, scale, seed=2):
    """All distances of every round, in Python's integers; rows are (id, vector)."""
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        sides = [place(v)[1] for _, v in kept]
        for c in range(len(centres)):
            if mine := [v for (_, v), s in zip(kept, sides, strict=True) if s == c]:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    final = [place(v) for _, v in kept]
    inertia = {c: sum(d for d, s in final if s == c) for _, c in final}
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                  for (i, _), (d, c) in zip(kept, final, strict=True))


def vectors(seed, n, dimensions, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(6)]
    out = [(i, [c + rng.gauss(0, 0.15) * spread for c in rng.choice(middles)]) for i in range(n)]
    out += [(n + i, list(out[0][1])) for i in range(n // 3)]  # one vector many times
    out += [(7, list(out[3][1])), (None, list(out[4][1])), (None, [0.5] * dimensions)]
    out += [(9001, None), (9002, []), (9003, [0.0] * (dimensions - 1)), (9004, [None] + [0.0] * (dimensions - 1)),
            (9005, [float("nan")] * dimensions), (9006, [float("inf")] * dimensions)]
    return out


@pytest.mark.parametrize(("k", "rounds", "scale", "spread"), [(9, 5, 256, 1.0), (9, 3, 2, 1.0), (40, 2, 256, 0.0), (1, 2, 256, 1.0), (500, 1, 256, 1.0), (5, 0, 256, 1.0)])
def test_equals_all_distances(spark, k, rounds, scale, spread):
    rows = vectors(k, 200, 6, spread)
    frame = spark.createDataFrame([(i, v, 0, "extra", 1) for i, v in rows], SCHEMA).repartition(3)
    got = sorted((str(r[0]), *r[1:]) for r in clustering.cluster(frame, k=k, rounds=rounds, dimensions=6, scale=scale).collect())
    assert got == brute(rows, k, rounds, 6, scale)


def test_very_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.choice([1.0, 1e6, -1e6]) * rng.random())) for _ in range(4)]) for i in range(60)]
    frame = spark.createDataFrame([(i, v, 0, "", 1) for i, v in rows], SCHEMA)
    got = sorted((str(r[0]), *r[1:]) for r in clustering.cluster(frame, k=5, rounds=3, dimensions=4).collect())
    assert got == brute(rows, 5, 3, 4, 256)
    rows += [(100, [3e38, 0.0, 0.0, 0.0]), (101, [-3e38, 0.0, 0.0, 0.0])]  # beyond 64 bits: no crash, no wrong number
    frame = spark.createDataFrame([(i, v, 0, "", 1) for i, v in rows], SCHEMA)
    got = clustering.cluster(frame, k=2, rounds=2, dimensions=4).collect()
    assert len(got) == 62 and all(r.distance is None or r.distance >= 0 for r in got)


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16)) * 2000
    x = (middles[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 300).astype(np.int64)
    centres = clustering.Centres([tuple(map(int, p)) for p in x[:40]])
    state = [np.full(len(x), -1, np.int32), np.full(len(x), -1, np.int32), np.zeros(len(x)), np.zeros(len(x))]
    done = []
    for _ in range(5):
        *state, counted = clustering.search(x, *state, centres)
        done.append(counted)
        mean = [tuple((x[state[0] == c].sum(0) // max(1, (state[0] == c).sum())).tolist()) for c in range(40)]
        centres = clustering.Centres(mean).moved_from(centres)
    everything = 40 * len(x)
    assert done[0] < everything and sum(done) < 5 * everything / 3 and max(done[1:]) < everything / 2


def test_empty_table(spark):
    got = clustering.cluster(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0
