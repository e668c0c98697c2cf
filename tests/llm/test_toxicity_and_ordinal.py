import random
import zlib

from larder.llm import ordinal, toxicity
from tests.llm.helpers import prose

BAD = ["moron", "worthless", "vejute"]


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = prose(rng, rng.randint(15, 40)).split()
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", ","]))
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_disguised_words_are_restored(spark):
    data = rows()
    hidden = ["w0rthl3ss", "m o r o n", "mmmoooorrrooonnn", "m.o.r.o.n", "W0RTHLES$", "moron!!", "vejutes"]
    texts = [(1000 + i, f"{prose(random.Random(i), 12)} {h} {prose(random.Random(i + 50), 12)}") for i, h in enumerate(hidden)]
    clean = [(2000, prose(random.Random(7), 60)), (2001, "1 2 3 4 5 a 1 b 2 c 3"), (2002, "$$$ *** ### a| b|"), (2003, None), (2004, "")]
    docs = spark.createDataFrame([(i, t, i) for i, t, _ in data] + [(*x, 0) for x in texts + clean + [(2000, clean[0][1])]], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(data) + len(texts) + len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in data if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [got[i].predicted for i, _ in texts] == [1] * len(texts)
    assert [got[i].predicted for i, _ in clean] == [0] * len(clean)


def test_held_out_labels_are_not_read(spark):
    data = rows(2, 120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flip = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in data]
    a = toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    b = toxicity.toxicity(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_without_labels_or_documents(spark):
    docs, labels = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, labels).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    ratings = spark.createDataFrame([], "doc_id long, grade int")
    assert [r.tail_1 for r in ordinal.graded(docs, ratings).collect()] == [0.5, 0.5]
    assert ordinal.graded(docs.limit(0), ratings).count() == 0


def test_grades_in_order(spark):
    rng = random.Random(8)

    def text(grade):
        w = prose(rng, rng.randint(20, 60)).split()
        mark = {0: "junk***", 1: "fair", 2: "fine"}[grade]
        return " ".join(mark if rng.random() < 0.15 else x.upper() if grade == 0 else x for x in w)

    data = [(i, text(i % 3), i % 3) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, None, "x"), (9999, "", "x")], "doc_id long, text string, kept string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in data if i % 2] + [(None, 1), (3, None)], "doc_id long, grade int")
    rows_ = ordinal.graded(docs, ratings).collect()
    assert len(rows_) == 602
    got = {r.doc_id: r for r in rows_}
    assert all(r.tail_1 >= r.tail_2 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-9 and r.kept == (r.tail_1 >= 0.5) for r in rows_)
    held = [(round(got[i].expected_grade), g) for i, _, g in data if not i % 2]
    assert sum(a == g for a, g in held) >= 0.9 * len(held)


def scorer():
    table = {"=moron": 0.9, "moron": 0.9, "=worthless": 0.9, "worthl": 0.9, "=vejute": 0.9, "=morons": 0.9}
    return toxicity.Scorer(table, toxicity.np.full((toxicity.SYMBOLS,) * 3, -3.0, "f4"), 0.01)


def test_spaced_words_among_other_single_letters():
    spaced = ["you are a m o r o n today", "so m o r o n.", "well \"m o r o n\", he said", "I 4 - m o r o n", "y m 0 r o n s", "m. o. r. o. n.",
              "a w o r t h l e s s m o r o n i s", "x y z " * 20 + "v e j u t e " + "b c d " * 20, "a v v e e j j u t t e n"]
    assert [t for t in spaced if scorer().of_text(t) < 0.5] == []
    clean = ["a m o r t", "1 2 3 4 5 0 7 0 9", "a b c d e", "m o", "m o r o", "J. R. R. Tolkien", "a " * 500 + "b"]
    assert [t for t in clean if scorer().of_text(t) >= 0.5] == []


def test_words_in_tokens_of_any_length():
    joined = "one/of/the/longest/of/all/possible/"
    tokens = ["m" + "o" * 60 + "ron", "m" * 20 + "o" * 20 + "r" * 20 + "on", "".join(c * 9 for c in "worthless"), joined + "m0r0n", joined + "moron/ones",
              joined + "m.o.r.o.n/so", joined + "w-o-r-t-h.l.e.s.s", "you-are-a-m0r0n", joined + "mo-ron", "".join(c * 40 for c in "m0r0n")]
    assert [t for t in tokens if scorer().of_text("well " + t + " there") < 0.5] == []
    clean = ["https://www.example.com/a/long/path/of/many/parts-with-dashes", "x" * 5000, "com/o/r/o/nothing/of/that/kind/here/at/all", "ab" * 3000]
    assert [t for t in clean if scorer().of_text(t) >= 0.5] == []


def test_repetition_is_counted_on_whole_hashes():
    import pyarrow as pa

    words = [f"w{i}" for i in range(100_000)]
    (_, keys, values), = ordinal.hashed(pa.array([" ".join(words)]))
    size = 16  # log2 of its words
    wanted = [size * 16 + 8, 1000 + size * 16 + 8, 2000 + 8]
    marks = [int(ordinal.mix(ordinal.np.array([m], "u8"))[0] % ordinal.U64(ordinal.BUCKETS)) for m in wanted]
    assert keys[-3:].tolist() == marks and (values[-3:] == ordinal.MARK).all()
