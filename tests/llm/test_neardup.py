import random

import numpy as np
import pytest

from larder.llm import neardup
from larder.llm.components import components
from larder.llm.signatures import superminhash
from larder.llm.textblocks import Words, text_blocks
from tests.llm.helpers import corpus, shingles


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    roots = union_find(len(sets), links)
    return [(len(s), r, r == i) for i, (s, r) in enumerate(zip(sets, roots))]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    texts = corpus(seed, groups=25)
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, size int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len({w[1] for w in want}) < len(texts) - 10


def test_repeated_rows_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (7, "")], schema)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("7", "7", True), ("None", "3", False), ("None", "None", True)]
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    names = rng.sample(range(-10**15, 10**15), 300)
    links = [(names[i], names[i + 1]) for i in range(299) if i % 50 != 49] + [(names[0], names[0])]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: min(names[i // 50 * 50 : i // 50 * 50 + 50]) for i, x in enumerate(names)}


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(5)
    errors = []
    for size in (3, 20, 200, 2000):
        pool = rng.integers(0, 2**63, 3 * size, dtype=np.uint64)
        left, right = pool[: 2 * size], pool[size:]
        sig = superminhash(np.concatenate([left, right, left, left]), np.array([0, 2 * size, 4 * size, 8 * size, 8 * size]), 80)
        assert (sig[0] == sig[2]).all() and (sig[3] == ~np.uint64(0)).all() and (sig[:3] != ~np.uint64(0)).all()
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert max(map(abs, errors)) < 0.2


def test_words_and_shingles_equal_python():
    import pyarrow as pa

    texts = corpus(9)
    for _, _, data, starts in text_blocks(pa.array(texts, pa.string()), block=200):
        hashes, bounds = Words(data, starts).shingles()
        assert len(bounds) == len(starts)
    whole = next(text_blocks(pa.array(texts, pa.string())))
    hashes, bounds = Words(whole[2], whole[3]).shingles()
    names = {}
    for i, text in enumerate(texts):
        own = hashes[bounds[i] : bounds[i + 1]]
        assert len(set(own.tolist())) == len(shingles(text))
        for h, s in zip(sorted(set(own.tolist())), sorted(shingles(text)) if len(own) == 1 else []):
            assert names.setdefault(s, h) == h
