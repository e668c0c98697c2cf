import random

import corpus_pipeline
from larder.llm import queries
from tests.llm.helpers import prose, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else prose(rng, 1) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    passage = text(rng, 120)
    clean = [text(rng, rng.randint(60, 200)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i], "en", "s0", 1) for i in range(5)]  # copies
    rows += [(200, None, "en", "s0", None), (201, "", "en", None, 0), (202, "Und " * 50, "de", "s1", 200)]  # junk
    rows += [(300 + i, f"{text(rng, 60)} {passage} {text(rng, 60)}", "en", "s2", 1) for i in range(3)]  # a shared passage
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(folder))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "mix_sources":
            assert ids == set(range(20)) | {300, 301, 302} | ({100, 101, 102, 103, 104} if name == "quality_rules" else set())
        if name == "repeated_strings":
            shared = [r.text for r in docs.where("doc_id >= 300").collect()]
            assert all(passage[10:100] not in t and len(t) > 200 for t in shared)
            assert {r.text for r in docs.where("doc_id < 300").collect()} == set(clean)
    packed = corpus_pipeline.run(spark, str(folder))
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in packed.collect()} == ids


def test_every_query_has_a_name_of_its_operator():
    names = queries.all_queries()
    assert [n for n in names if n != "pipeline"] and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.SQL) <= set(names)


def run_stages(spark, docs, upto, folder):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name == upto:
            return docs


def test_pairs_of_similarity_from_80_percent_are_near_duplicates(spark, tmp_path):
    rng = random.Random(11)
    rows, left, likeness = [], {}, []
    for i in range(40):
        base = text(rng, 154)
        words = base.split()
        other = " ".join(words[:139]) + " " + text(rng, 15)
        a, b = shingles(base), shingles(other)
        likeness.append(len(a & b) / len(a | b))
        rows += [(2 * i, base, "en", "s0", 1), (2 * i + 1, other, "en", "s0", 1)]
        left[2 * i] = base
    assert all(0.80 <= x < 0.85 for x in likeness)
    docs = run_stages(spark, spark.createDataFrame(rows, SCHEMA), "repeated_strings", tmp_path)
    assert {r.doc_id: r.text for r in docs.collect()} == left


def test_repeated_rows_shared_ids_and_null_ids(spark, tmp_path):
    rng = random.Random(12)
    a, b, c, d, e, f, g = (text(rng, 150) for _ in range(7))
    near = " ".join([*a.split()[:-4], *text(rng, 4).split()])  # of a
    rows = [(1, a), (1, a), (1, a), (1, near), (1, b), (2, c), (None, near), (None, d), (None, e), (None, e), (3, f), (3, c), (None, g), (4, g)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], SCHEMA)
    docs = run_stages(spark, docs, "repeated_strings", tmp_path)
    got = sorted((str(r.doc_id), r.text) for r in docs.collect())
    first = {r for r in got if r[1] in (a, near)}
    assert len(first) == 1 and first < {("1", a), ("1", near)}
    assert sorted(set(got) - first) == sorted([("1", b), ("2", c), ("None", d), ("None", e), ("3", f), ("4", g)]) and len(got) == 7
    mixed = corpus_pipeline.mix_sources(spark, docs, None)
    assert sorted({(str(r.doc_id), r.text) for r in mixed.collect()}) == got
    packed = corpus_pipeline.pack_sequences(spark, docs, None).collect()
    ends = {}
    for r in packed:
        ends.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert {i: len(n) for i, n in ends.items()} == {1: 2, 2: 1, None: 2, 3: 1, 4: 1}


def test_passages_of_51_words_go_and_shorter_ones_stay(spark, tmp_path):
    rng = random.Random(13)
    passages = {n: text(rng, n) for n in (40, 50, 51, 55, 70)}
    rows, left = [], {}
    for n, passage in passages.items():
        for i in range(3):
            before, after = text(rng, 70), text(rng, 70)
            before, after = f"{before} q{n}x{i}", f"z{n}x{i} {after}"  # else a common word beside it may repeat, too
            rows.append((10 * n + i, f"{before} {passage} {after}", "en", "s0", 1))
            left[10 * n + i] = f"{before}  {after}" if n > 50 else rows[-1][1]
    docs = run_stages(spark, spark.createDataFrame(rows, SCHEMA), "repeated_strings", tmp_path)
    assert {r.doc_id: r.text for r in docs.collect()} == left


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
