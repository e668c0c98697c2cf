import hashlib
import random

import pyarrow as pa

from larder.llm import revisits, sketches
from tests.llm.helpers import corpus, shingles


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_edited_texts(spark):
    texts = corpus(3, groups=20, size=700)
    ids = sorted(random.Random(1).sample(range(-50, 10**6), len(texts)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, part int").repartition(5)
    got = {r.doc_id: r for r in sketches.edited_likeness(docs).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    same = {}
    for k, (i, text) in enumerate(zip(ids, plain)):
        after, r = plain[(k + 1) % len(plain)], got[i]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(text), shingles(edited))) < 0.25
        assert abs(r.near_next - jaccard(shingles(text), shingles(after))) < 0.25
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
        if len(shingles(text) | shingles(edited)) <= sketches.K:
            assert r.near_edited == jaccard(shingles(text), shingles(edited))


def test_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "null id"), (4, "bb bb"), (4, "aa aa"), (9, None), (4, "bb bb")], schema)
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in sketches.edited_likeness(docs).collect())
    order = ["null id", "aa aa", "bb bb", "bb bb", ""]
    names = ["None", "4", "4", "4", "9"]
    edit = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    assert got == sorted((n, len(a), edit(a, b)) for n, a, b in zip(names, order, order[1:] + order[:1]))
    one = sketches.edited_likeness(docs.where("doc_id = 9")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)]
    assert sketches.edited_likeness(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    a, b = [" ".join(f"w{i}" for i in range(lo, lo + 4000)) for lo in (0, 2000)]
    left, right, both = sketches.sketches(pa.array([a, b, a + " " + b]))
    assert abs(left.distinct() - 3996) < 1200
    assert abs(left.resemblance(right) - 1 / 3) < 0.15 and abs(left.containment(right) - 0.5) < 0.2
    assert len(left.merge(right).hashes) == sketches.K and abs(left.merge(right).distinct() - 5992) < 1800
    assert (sketches.Sketch.parse(left.text()).hashes == left.hashes).all()
    assert sketches.Sketch.parse("").distinct() == 0.0


CAPTURE = "capture_id long, url string, ts long, status int, etag string, last_modified string, digest string, n_body long, headers map<string,string>, outcome string"


def capture(i, url, ts, status, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, status, etag, modified, digest, None if digest is None else len(digest), headers, "x")


def test_revisits_against_a_walk(spark):
    rng = random.Random(5)
    spell = ["http://A.example/x", "https://a.example/x/", "https://a.example:443/x#f", "https://a.example/x?utm_source=q", "https://a.example/y"]
    data = []
    for i in range(300):
        full = rng.random() < 0.3
        data.append(capture(i, rng.choice(spell + [None]), rng.choice([None, *range(0, 400_000, 20_000)]), 200 if full else rng.choice([304, 304, 404, None]),
                            rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "d1", "d2"]), rng.choice(["aa", "bbb"]) if full else None,
                            {"ETag": "e", "Server": f"s{i}", "date": str(i)}))
    got = {r.capture_id: r for r in revisits.resolve(spark.createDataFrame(data, CAPTURE)).collect()}
    assert len(got) == 300
    key = lambda url: None if url is None else "y" if url.endswith("y") else "x"
    outcomes = set()
    for i, url, ts, status, etag, modified, digest, _, headers, _ in data:
        r = got[i]
        outcomes.add(r.outcome)
        if status != 304:
            assert (r.outcome, r.digest, r.headers, r.source_id) == ("full", digest, headers, None)
            continue
        before = [c for c in data if c[3] == 200 and key(c[1]) == key(url) and url and ts is not None and c[2] is not None and c[2] < ts]
        if not before:
            assert r.outcome == "orphan" and r.digest is None
            continue
        source = max(before, key=lambda c: (c[2], c[0]))
        if etag and source[4]:
            same = etag.removeprefix("W/") == source[4].removeprefix("W/")
        elif modified and source[5]:
            same = modified == source[5]
        else:
            same = None
        assert r.outcome == {True: "resolved", False: "changed", None: "unchecked"}[same]
        if same:
            assert (r.source_id, r.digest, r.status) == (source[0], source[6], 200)
            assert r.headers == {"Server": f"s{source[0]}", "ETag": "e", "date": str(i)}
        else:
            assert r.source_id is None and r.digest is None
    assert outcomes == {"full", "orphan", "resolved", "changed", "unchecked"}
    assert revisits.resolve(spark.createDataFrame([], CAPTURE)).count() == 0


def test_canonical_addresses(spark):
    cases = {"HTTP://Ex.org:80/A?utm_a=1&b=2&utm_c=3#x": "https://ex.org/A?b=2", "https://ex.org/?utm_x=1": "https://ex.org", "": "", None: None,
             "https://ex.org/a//": "https://ex.org/a"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "url string, want string")
    assert [r.got for r in rows.select(revisits.canonical_url(rows.url).alias("got")).collect()] == list(cases.values())
