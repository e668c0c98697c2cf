"""Chunking, documents from files, vectors."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import chat, documents, vectors
from larder.sources import files


def chunks_of(spark, texts, limit):
    docs = spark.createDataFrame([("c", f"f{i}", t) for i, t in enumerate(texts)], "condition string, file_name string, text string")
    rows = documents.chunk_documents(docs, limit).orderBy("source_file", "chunk_index").collect()
    return [[r.text for r in rows if r.source_file == f"c/f{i}.md"] for i in range(len(texts))]


def walk(body, limit, splitters=("\n\n", "\n", ". ")):
    """Brute force: pack one level, then take every oversize piece apart on its own."""
    size = lambda t: len(t.split())
    usable = [s for s in splitters if s in body]
    if size(body) <= limit or not usable:
        return [body]
    cut, packed = usable[0], [""]
    for part in body.split(cut):
        longer = (packed[-1] + cut + part).strip() if packed[-1] else part.strip()
        if size(longer) <= limit:
            packed[-1] = longer
        else:
            packed.append(part.strip())
    return [c for piece in packed if piece for c in walk(piece, limit, splitters)]


def random_text(rng):
    seps = [" ", " ", " ", " ", "\n", ". ", ". ", "\n\n", " ", " \n", ".", "\n\n\n", ". . "]
    return "".join(rng.choice(["a", "bb", "ccc", ""]) + rng.choice(seps) for _ in range(rng.randrange(0, 120)))


def test_chunks_equal_brute_force(spark):
    rng = random.Random(17)
    texts = [t for t in (random_text(rng) for _ in range(400)) if t]
    for limit in (1, 5, 17):
        assert chunks_of(spark, texts, limit) == [walk(t, limit) for t in texts]


def test_chunk_limits(spark):
    words = lambda n: " ".join(["w"] * n)
    texts = [words(300), words(301), words(300) + "\n" + words(1), "  padded  ", words(200) + ". " + words(200) + "."]
    got = chunks_of(spark, texts, 300)
    assert [[len(c.split()) for c in doc] for doc in got] == [[300], [301], [300, 1], [1], [200, 200]]
    assert got[3] == ["  padded  "]  # a text that fits stays as it is


def test_chunks_keep_every_token(spark):
    rng = random.Random(23)
    texts = [t for t in (random_text(rng) for _ in range(200)) if t.strip()]
    letters = lambda t: [w.strip(".") for w in t.split() if w.strip(".")]
    for text, chunks in zip(texts, chunks_of(spark, texts, 5)):
        assert letters(text.replace(". ", " ")) == letters(" ".join(chunks).replace(". ", " "))


def test_empty_documents_are_skipped(spark):
    docs = spark.createDataFrame([("c", "f", ""), ("c", "g", None)], "condition string, file_name string, text string")
    assert documents.chunk_documents(docs).count() == 0


def test_budget_is_a_prefix_and_may_be_hit_exactly(spark):
    rows = [("d", i, " ".join(["w"] * n)) for i, n in enumerate([3, 4, 0, 3, 1])]
    chunks = spark.createDataFrame(rows, "doc string, i int, text string")
    kept = lambda budget: sorted(r.i for r in documents.budget_prefix(chunks, ["doc"], "i", budget).collect())
    assert kept(2) == [] and kept(7) == [0, 1, 2] and kept(10) == [0, 1, 2, 3] and kept(99) == [0, 1, 2, 3, 4]


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "Markdown_Conversions" / "CKD"
    folder.mkdir(parents=True)
    (folder / "CKD_1.md").write_text("line one\n\nline two")
    (folder / "empty.md").write_text("")
    (folder / "skip.txt").write_text("no")
    rows = files.read_documents(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("CKD", "CKD_1", "line one\n\nline two")]


def test_list_files_by_extension(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PDF"]


def vector_rows(spark, n=300, dim=8, seed=2):
    rng = random.Random(seed)
    data = [(f"c{i}", [rng.uniform(-1, 1) for _ in range(dim)], "hot" if rng.random() < 0.4 else f"k{i % 3}") for i in range(n)]
    return data, spark.createDataFrame(data, "chunk_id string, embedding array<float>, condition string")


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)


def test_top_k_equals_brute_force(spark):
    data, rows = vector_rows(spark)
    query = data[7][1]
    best = sorted(((-cosine(v, query), i) for i, v, c in data if c in ("hot", "k1")))[:9]
    got = vectors.top_k(rows, query, ["hot", "k1"], 9).collect()
    assert [r.chunk_id for r in got] == [i for _, i in best]


def test_unequal_dimensions_are_an_error(spark):
    _, rows = vector_rows(spark, 5)
    with pytest.raises(Exception, match="differ in dimension"):
        vectors.top_k(rows, [1.0, 2.0]).collect()


def test_zero_vector_has_no_cosine(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0], "x"), ("b", [1.0, 0.0], "x")], "chunk_id string, embedding array<float>, condition string")
    assert [(r.chunk_id, r.score) for r in vectors.top_k(rows, [1.0, 0.0]).collect()] == [("b", 1.0), ("a", None)]


SCHEMA = "chunk_id string, embedding array<float>, source_file string, text string"


def test_upsert(spark):
    table = spark.createDataFrame([("f_0", [1.0], "f", "old"), ("f_1", [1.0], "f", "tail"), ("g_0", [1.0], "g", "g")], SCHEMA)
    batch = spark.createDataFrame(
        [("f_0", [2.0], "f", "v1", 1), ("f_0", [2.0], "f", "v2", 2), ("h_0", [], "h", "no vector", 1)],
        SCHEMA + ", version int")
    texts = lambda **kw: sorted((r.chunk_id, r.text) for r in vectors.upsert(table, batch, **kw).collect())
    assert texts() == [("f_0", "v2"), ("f_1", "tail"), ("g_0", "g")]
    assert texts(replace_document=True) == [("f_0", "v2"), ("g_0", "g")]


def test_scratchpad_takes_the_last_steps_before_dropping_pending_ones(spark):
    steps = spark.createDataFrame(
        [(1, i, "t", f"in{i}", "TBD" if i in (2, 5) else f"out{i}") for i in range(6)],
        "conv_id long, turn long, tool string, tool_input string, log string")
    assert chat.scratchpad(steps).first().scratchpad == (
        "Tool: t, Input: in3\nOutput: out3\n---\nTool: t, Input: in4\nOutput: out4")
    assert chat.full_log(steps).first().parts == 4
    assert chat.map_roles(steps.withColumn("role", F.lit("human"))).first().role == "user"
