import random
from collections import Counter

from larder.llm import mixing, quality
from tests.llm.helpers import prose, words

SCHEMA = "doc_id long, text string, source string, m int, kept string"


def measure(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a b c d e a b c d e", "x " * 40, "the of\nthe of\n\nthe of \x0b\n and\n", "a|b <c> #$%&*!     y"]
    for _ in range(30):
        part = prose(rng, rng.randint(1, 12))
        texts.append("\n".join(rng.choice([part, prose(rng, 6)]) for _ in range(rng.randint(1, 8))))
    docs = spark.createDataFrame([(i, t, "s", 1, "k") for i, t in enumerate(texts)], SCHEMA)
    rows = quality.judge(docs).orderBy("doc_id").collect()
    assert [(r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words) for r in rows] == list(map(measure, texts))
    for r in rows:
        assert r.base_failed == (r.m.n_words < 10 or 100 * r.m.n_repeat_words > 20 * r.m.n_words)
        assert not (r.kept and r.base_failed)


def test_verdict_needs_no_python(spark):
    docs = spark.createDataFrame([(1, "x", "s", 1, "k")], SCHEMA)
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality.judge(docs.limit(0)).count() == 0


def test_clean_prose_is_kept_and_junk_is_not(spark):
    rng = random.Random(5)
    clean = " ".join(rng.choice(["the", "of", "and", prose(rng, 1), prose(rng, 1)]) for _ in range(80))
    shout = " ".join(w.upper() + "!!" for w in clean.split())
    symbols = " ".join(w + "***" for w in clean.split())
    table = " | ".join(prose(rng, 60).split())
    docs = spark.createDataFrame([(i, t, "s", 1, "k") for i, t in enumerate([clean, shout, symbols, table, "Und " * 60])], SCHEMA)
    assert [r.kept for r in quality.judge(docs).orderBy("doc_id").collect()] == [True, False, False, False, False]


def fill(sizes, weights, epochs):
    """Clamp and share anew until nothing is above its cap."""
    total, clamped = sum(sizes), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in clamped)
        weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        target = [epochs * s if i in clamped else rest * weights[i] / weight for i, s in enumerate(sizes)]
        new = {i for i, s in enumerate(sizes) if i not in clamped and target[i] > epochs * s}
        if not new:
            return target
        clamped |= new


def test_targets_and_takes(spark):
    rng = random.Random(6)
    rows = []
    for source, n in (("b", 3), (None, 40), ("a", 2), ("Z", 200), ("é", 30), ("empty", 2)):
        rows += [(len(rows) + i, None if source == "empty" else prose(rng, rng.randint(0, 30) or 1), source, 1, "k") for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    order = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(t)) for _, t, s, *_ in rows if s == name) for name in order]
    target = fill(sizes, [1 + i % 3 for i in range(len(order))], 3)
    for name, size, want in zip(order, sizes, target):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - want) < 1e-6 * max(1, want) for r in own)
        assert abs(sum(r.taken for r in own) - want) <= max(r.size for r in own)
    assert all(r.taken == r.size * r.times and r.times <= 3 for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.times for r in got if r.times})


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).columns == docs.columns
    blank = spark.createDataFrame([(1, None, None, 1, "k"), (1, "", None, 1, "k")], SCHEMA)
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]
