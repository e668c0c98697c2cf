import hashlib
import random
import re
from collections import Counter

import pytest

from larder.llm import suffixes
from tests.llm.helpers import fold

SCHEMA = "doc_id long, text string, n_bytes string, ROW long"


def brute(texts, length):
    """n_removed, n_spans and the remaining bytes of each text, string by string."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßñ中") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.choice([15, 30, 80]))) for _ in range(4)]
    texts = [None, "", "x", "ab" * 400, "a" * 900, "a" * 90]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice([*passages, ""]))
        texts.append(" ".join(parts))
    texts += texts[6:9]
    edited = texts[10].split(" ")
    edited[len(edited) // 2] = "changed"
    texts.append(" ".join(edited))
    return texts


@pytest.mark.parametrize(("length", "together"), [(40, 1024), (40, 2), (100, 1024)])
def test_removal_equals_string_by_string(spark, length, together):
    texts = corpus(length)
    docs = spark.createDataFrame([(i, t, "extra", i) for i, t in enumerate(texts)], SCHEMA)
    got = suffixes.remove_repeats(docs, length=length, together=together, batches=3).orderBy("doc_id").collect()
    want = brute(texts, length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert sum(r.n_removed for r in got) > 0
    assert got[0].kept_text is None and got[1].kept_text == ""


def test_equal_rows_and_null_ids_are_documents_of_their_own(spark):
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 7) for i in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:500]), (2, text[:399])], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs).collect()}
    assert got[(1, 600)][0] == 600 and got[(None, 500)] == (500, 1) and got[(2, 399)] == (0, 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert suffixes.remove_repeats(docs).count() == 0


def brute_words(texts, length):
    """Bytes removed, runs, remaining bytes and words in repeated strings of each text, string of words by string of words."""
    split = [[(fold(m.group()), len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in (t or "" for t in texts)]
    count = Counter(tuple(w for w, *_ in d[i : i + length]) for d in split for i in range(len(d) - length + 1))
    out = []
    for t, d in zip(texts, split, strict=True):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[tuple(w for w, *_ in d[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        runs, left, upto, data = 0, b"", 0, (t or "").encode()
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                left, runs = left + data[upto : d[i][1]], runs + 1
            if g:
                upto = d[i][2]
        left += data[upto:]
        out.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(), sum(gone)))
    return out


def passages_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßñ中") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (50, 51, 51, 55, 80, 120)]
    texts = [None, "", "x", "ab " * 400, "a " * 52, "a " * 50]
    for i in range(60):
        parts = [[word() for _ in range(rng.randint(0, 60))] for _ in range(3)]
        parts.insert(rng.randint(0, 3), [w.upper() if i % 7 == 0 and w.isascii() else w for w in passages[i % 6]])
        texts.append(rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    return texts + texts[6:9]


@pytest.mark.parametrize(("seed", "together"), [(1, 1024), (2, 3)])
def test_passages_of_more_than_50_words(spark, seed, together):
    texts = passages_corpus(seed)
    docs = spark.createDataFrame([(i, t, "extra", i) for i, t in enumerate(texts)], SCHEMA)
    got = suffixes.remove_repeats(docs, length=suffixes.WORDS, units=suffixes.WordRuns, together=together, batches=3).orderBy("doc_id").collect()
    want = brute_words(texts, 51)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [w[:4] for w in want]
    assert sum(r.n_removed for r in got) > 0
    both = suffixes.remove_repeats(docs, length=100, with_text=False, passages=51, together=together).orderBy("doc_id").collect()
    assert [r.passage_words for r in both] == [w[4] for w in want]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in both] == brute(texts, 100)


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, "x y z " + long[600_000 : 600_500] + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, with_text=False, passages=51).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (500, 500, 0)
    whole = long[600_000 : 600_500].strip().split(" ")
    inside = len(whole) - (long[599_999] != " ") - (long[600_500] != " ")
    assert got[1].passage_words == got[2].passage_words and 0 <= got[1].passage_words - inside <= 2 and got[3].passage_words == 0


def test_many_runs_of_one_suffix_make_few_rows(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(1500))
    texts = []
    for _ in range(150):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("XYZ") + base[at + 1 :])
    made, parted, suffix_rows = [], suffixes._large, []

    def counted(runs, units, length, gram):
        suffix_rows.append(runs.count())
        spans, tables = parted(runs, units, length, gram)
        made.extend(t.count() for t in tables)
        return spans, tables

    monkeypatch.setattr(suffixes, "_large", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.remove_repeats(docs, together=20, batches=2).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, 400)
    assert suffix_rows[0] > 100 and sum(made) < 60 * suffix_rows[0]
