import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import pitmanyor
from larder.llm.seating import FEW, reseat
from larder.llm.textblocks import U64, Words, mix, text_blocks
from tests.llm.helpers import fold, words

SCHEMA = "doc_id long, text string, score string, held_out int"


def word_hash(word):
    if word is None:
        return int(pitmanyor._END)
    (_, _, data, starts), = text_blocks(pa.array([word]))
    return int(Words(data, starts).hashes()[0])


def name_of(number):
    return mix(np.array([number], np.uint64))


def numbers(vocabulary, bits):
    """The words' numbers, which name the dishes to the sampler: place among the hashes with the same first bits, then these."""
    places, out = Counter(), {}
    for w in sorted(vocabulary, key=word_hash):
        bucket = word_hash(w) >> (64 - bits)
        out[w] = places[bucket] * 2**bits + bucket
        places[bucket] += 1
    return out


def brute(rows, burn_in, samples, bits=0):
    """The same model with one dictionary entry and one call of the sampler per dish; also its probabilities and words."""
    texts = [[fold(w) for w in words(t)] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    n = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    total, known = sum(n.values()), len(n)
    number = numbers({w for t in texts for w in t}, bits)
    pairs = lambda t: list(zip([None, *t[:-1]], t, strict=True))
    c = Counter(p for t, h in zip(texts, held, strict=True) if not h for p in pairs(t))
    discount = lambda counts: min(.95, max(.05, sum(x == 1 for x in counts) / (sum(x == 1 for x in counts) + 2 * sum(x == 2 for x in counts)))) if 1 in counts else .5
    d = discount(list(c.values()))
    seated = lambda k: (np.array([k])[:k > FEW], np.array([k]), np.array([1]))  # tables of a large dish, customers, tables
    tables = {p: seated(k) for p, k in c.items()}
    count = lambda x: int(x[2][0])
    served = lambda: Counter({w: sum(count(tables[p]) for p in tables if p[1] == w) for w in n})
    restaurant = lambda u: sum(count(x) for p, x in tables.items() if p[0] == u)
    root = {w: seated(k) for w, k in served().items()}
    top = discount([int(x[1][0]) for x in root.values()])

    def again(name, dish, wanted, total, chance, disc, salt):
        flat, t = reseat(name, dish[0], dish[1], dish[2], np.array([wanted]), np.array([total]), np.array([chance]), 1.0, disc, salt)
        return flat, np.array([wanted]), t

    def chances():
        whole = sum(int(x[1][0]) for x in root.values()) + 1
        rest = (1 + top * sum(count(x) for x in root.values())) / (known + 1) / whole
        return {w: (root[w][1][0] - top * count(root[w])) / whole + rest for w in root} | {"?": rest}

    averages = []
    for sweep in range(1, burn_in + samples + 1):
        chance, of = chances(), {u: restaurant(u) for u in {p[0] for p in tables}}
        for p, x in tables.items():
            if c[p] > 1:
                u, w = number[p[0]], number[p[1]]
                with np.errstate(over="ignore"):
                    name = mix(mix(np.array([u], np.uint64) + U64(7)) + U64(w))
                tables[p] = again(name, x, c[p], of[p[0]], chance[p[1]], d, 2 * sweep)
        all_tables = sum(count(x) for x in root.values())
        for w, k in served().items():
            root[w] = again(name_of(number[w]), root[w], k, all_tables, 1 / (known + 1), top, 2 * sweep + 1)
        if sweep > burn_in:
            averages.append((chances(), {p: count(x) for p, x in tables.items()}, {u: restaurant(u) for u in n}))

    def probability(u, w):
        return sum(
            (max(0.0, c[(u, w)] - d * t.get((u, w), 0)) + (1 + d * of.get(u, 0)) * chance.get(w, chance["?"])) / (n[u] + 1)
            for chance, t, of in averages) / samples

    out = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        base = sum(math.log10((n[w] + .1) / (total + .1 * (known + 1))) for w in t)
        out.append((i, h, len(t), sum(n[w] > 0 for w in t), total, base, sum(math.log10(probability(u, w)) for u, w in pairs(t))))
    return out, probability, [*n, "?"]


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "a", *(f"w{i}é" for i in range(40))]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        for _ in range(rng.randint(0, size)):
            out.append(rng.choice(follow.get(out[-1], vocabulary)) if rng.random() < 0.8 else rng.choice([*vocabulary, f"x{rng.randrange(999)}"]))
        return rng.choice([" ", "\n", " \t"]).join(out)

    rows = [(i, text()) for i in range(60)] + [(100 + i, "one very common line of words") for i in range(60)]
    return rows + [(300, None), (301, ""), (302, " \n "), (None, text()), (None, None), (5, text()), (5, text())]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], SCHEMA)


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 3), round(r[5], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_dish_at_a_time(spark, seed):
    rows = corpus(seed, 40)
    want, probability, everything = brute(rows, 2, 2)
    same(pitmanyor.score(frame(spark, rows).repartition(4), burn_in=2, samples=2).collect(), want)
    # Dealt out in another way, with hot contexts and many buckets.
    same(pitmanyor.score(frame(spark, rows).repartition(2), burn_in=2, samples=2, block=500, grams=200, hot=50).collect(), want)
    for context in ["the", None, "?"]:
        assert sum(probability(context, w) for w in everything) == pytest.approx(1)


def test_many_word_buckets(spark):
    rows = corpus(4, 20)
    tokens = sum(len(words(t)) + 1 for _, t in rows)
    want, *_ = brute(rows, 1, 2, bits=3)
    same(pitmanyor.score(frame(spark, rows).repartition(3), burn_in=1, samples=2, block=100, words=tokens / 8, grams=300, hot=9).collect(), want)


def test_held_out_texts_are_better_predicted_than_by_single_words(spark):
    got = [r for r in pitmanyor.score(frame(spark, corpus(3, 200))).collect() if r.held_out]
    assert len(got) > 5 and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def stirling(c, strength, discount, others, parent):
    """Chances of 1, 2, ... tables for c customers, given all other tables."""
    row = [Fraction(1)]  # ways to seat n customers at 0, 1, ... tables
    for n in range(c):
        row = [(row[t - 1] if t else 0) + (n - Fraction(discount) * t) * (row[t] if t <= n else 0) for t in range(n + 2)]
        row = [Fraction(float(x / (n + 1))) for x in row]
    p, weight = [], 1.0
    for t in range(1, c + 1):
        weight *= (strength + discount * (others + t - 1)) * parent
        p.append(float(row[t]) * weight)
    return np.array(p) / sum(p)


@pytest.mark.parametrize(("c", "discount", "others", "parent", "error"), [
    (2, .7, 5, .1, .02), (7, .7, 50, .1, .02), (31, .8, 1000, .02, .02), (256, .7, 300, .03, .02), (257, .7, 300, .03, .05), (300, .5, 900, .01, .05)])
def test_tables_follow_their_exact_distribution(c, discount, others, parent, error):
    n = 2000
    tables, t = np.full(n if c > FEW else 0, c), np.ones(n, np.int64)
    for salt in range(25 if c <= FEW else 60):  # groups move slowly from the one table they start at
        tables, t = reseat(np.arange(n).astype(np.uint64), tables, np.full(n, c), t, np.full(n, c), others + t, np.full(n, parent), 1.0, discount, salt)
        if c > FEW:
            assert len(tables) == t.sum() and (tables > 0).all() and (np.add.reduceat(tables, np.cumsum(t) - t) == c).all()
    want = (stirling(c, 1.0, discount, others, parent) * np.arange(1, c + 1)).sum()
    assert abs(t.mean() - want) < error * want


def test_customers_come_and_go():
    rng = np.random.default_rng(5)
    wanted = rng.integers(0, 3000, 50)
    tables, t, before = np.zeros(0, np.int64), np.zeros(50, np.int64), np.zeros(50, np.int64)
    for salt, change in enumerate([1.0, 0.0, 2.0, 0.1, 1.0, 1.1]):
        now = (wanted * change).astype(int)
        tables, t = reseat(np.arange(50).astype(np.uint64), tables, before, t, now, t + 40, np.full(50, 0.01), 1.0, 0.6, salt)
        large = now > FEW
        sums = [int(x.sum()) for x in np.split(tables, np.cumsum(t[large])[:-1])] if large.any() else []
        assert sums == now[large].tolist() and ((t > 0) == (now > 0)).all() and (t <= now).all()
        before = now


def test_packing_of_numbers():
    for values in ([], [0], [255, 256], [-1, 5], [2**62, 0], [True, False]):
        assert pitmanyor.unpack(pitmanyor.pack(np.array(values, dtype=None if values else np.int64))).tolist() == [int(v) for v in values]
    assert pitmanyor.unpack(pitmanyor.pack(np.array([0.5, -1.0], np.float32))).tolist() == [0.5, -1.0]


def test_distinct_values():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 50, 400), rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2), np.zeros(0, np.int64),
                   np.repeat(np.arange(20, dtype=np.uint64) + np.uint64(2**63), 50)[rng.permutation(1000)]):  # these differ in low bits alone
        found, place = pitmanyor._distinct(values)
        assert (found == np.unique(values)).all() and (found[place] == values).all()


def test_places_by_value():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 9, 500), rng.integers(0, 2**62, 500), np.zeros(0, np.int64), np.full(70, 2**62), rng.integers(0, 4, 900) + 2**61):
        ordered, order = pitmanyor._sorted(values)
        assert order.tolist() == np.argsort(values, kind="stable").tolist() and ordered.tolist() == np.sort(values).tolist()


def a_block(tokens, vocabulary, seed=3):
    """A block of texts as `_identify` makes it; a few words are very frequent."""
    rng = np.random.default_rng(seed)
    lengths = rng.multinomial(tokens - tokens // 100, np.full(tokens // 100, 100 / tokens)) + 1
    places = np.minimum(rng.zipf(1.2, lengths.sum()) - 1, vocabulary - 1)
    places[np.cumsum(lengths) - 1] = vocabulary - 1  # the ends of texts
    numbers, counts = rng.permutation(4 * vocabulary)[:vocabulary], np.bincount(places, minlength=vocabulary)
    held = rng.random(len(lengths)) < 0.1
    return (0, "block", 0, 0, [pitmanyor.pack(x) for x in (lengths, held, held, lengths, numbers, counts, places)]), counts, held, lengths, numbers, places


@pytest.mark.parametrize("hot", [1e18, 300])
def test_pairs_of_a_block(hot):
    block, counts, held, lengths, numbers, places = a_block(20_000, 3000)
    bounds, contexts, pair_words, learned, place = pitmanyor._pairs(block, 7, hot)
    text = np.repeat(np.arange(len(lengths)), lengths)
    before = np.concatenate([places[-1:], places[:-1]])
    assert (contexts[place] == numbers[before]).all() and (pair_words[place] == numbers[places]).all()
    assert learned.tolist() == np.bincount(place[~held[text]], minlength=len(learned)).tolist()
    name = lambda x: mix(x.astype(np.uint64) + U64(1))
    spread = np.isin(contexts, numbers[counts >= hot])
    with np.errstate(over="ignore"):
        home = np.where(spread, mix(name(contexts) + pair_words.astype(np.uint64)), name(contexts)) % U64(7)
    assert spread.any() == (hot < 1e9) and len(set(zip(contexts.tolist(), pair_words.tolist(), strict=True))) == len(contexts)
    assert (np.lexsort([pair_words, contexts, home]) == np.arange(len(contexts))).all()
    assert bounds.tolist() == np.searchsorted(home, np.arange(8)).tolist()


def test_pairs_of_a_block_are_not_sorted_by_several_keys(monkeypatch):
    """Bucket, context and word of all pairs went through lexsort, and words' buckets too, three times for every block."""
    slow = []
    for name in ("lexsort", "argsort"):
        def noted(*args, sort=getattr(np, name), **kwargs):
            slow.append(np.shape(args[0]))
            return sort(*args, **kwargs)
        monkeypatch.setattr(np, name, noted)
    block, *_ = a_block(20_000, 3000)
    pitmanyor._pairs(block, 7, 300)
    assert not slow


def test_odd_tables(spark):
    empty = pitmanyor.score(frame(spark, []))
    assert empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and empty.count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = pitmanyor.score(frame(spark, [(i, "a b") for i in held])).collect()  # nothing to learn from
    assert all((r.train_tokens, r.n_known, r.n_tokens, r.base_score, r.score) == (0, 0, 3, 0.0, 0.0) for r in got) and len(got) == 3
    long = " ".join(f"w{i % 5000}" for i in range(150_000))  # beyond a block of texts
    rows = [(1, long), (2, "w1 w2 w3"), (3, "W1 w2")]
    got = {r.doc_id: r for r in pitmanyor.score(frame(spark, rows)).collect()}
    assert got[1].n_tokens == 150_001 and got[2].score > -4 and got[1].score > got[1].base_score
