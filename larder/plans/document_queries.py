"""Documents, vectors and chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import vocab
from larder.functions import text
from larder.operators import chat, documents, scale, vectors
from larder.plans.registry import query
from larder.plans.views import load, view, with_views
from larder.sources import scratch

BASE_URL = "https://files.example.org"


def _tokens(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> ''))"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


@query("token_count", f"SELECT doc_id, CAST({_tokens('text')} AS BIGINT) AS tokens FROM documents")
def token_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", text.token_count(F.col("text")).cast("long").alias("tokens"))


def _level(number: int, splitter: str, limit: int) -> list[str]:
    """Greedy packing of one level, walked part by part as a recursive query."""
    source = f"pieces{number}"
    divides = f"{_tokens('t')} > {limit} AND contains(t, {splitter})"
    return [
        f"""parts{number} AS MATERIALIZED (SELECT doc_id, ord, unnest(string_split(t, {splitter})) AS p,
          generate_subscripts(string_split(t, {splitter}), 1) AS i FROM {source} WHERE {divides})""",
        f"""walk{number} AS (SELECT doc_id, ord, i, {_strip('p')} AS cur, CAST(NULL AS VARCHAR) AS done FROM parts{number} WHERE i = 1
          UNION ALL SELECT doc_id, ord, i, CASE WHEN {_tokens('cand')} <= {limit} THEN cand ELSE p END,
            CASE WHEN {_tokens('cand')} > {limit} AND cur <> '' THEN cur END
          FROM (SELECT w.doc_id, w.ord, n.i, w.cur, {_strip('n.p')} AS p,
            CASE WHEN w.cur = '' THEN {_strip('n.p')} ELSE {_strip(f"w.cur || {splitter} || n.p")} END AS cand
            FROM walk{number} w JOIN parts{number} n ON n.doc_id = w.doc_id AND n.ord = w.ord AND n.i = w.i + 1))""",
        f"""out{number} AS (SELECT doc_id, ord, i, done AS t FROM walk{number} WHERE done IS NOT NULL
          UNION ALL SELECT doc_id, ord, max(i) + 1, arg_max(cur, i) FROM walk{number} GROUP BY doc_id, ord HAVING arg_max(cur, i) <> ''
          UNION ALL SELECT doc_id, ord, 0, t FROM {source} WHERE NOT ({divides}))""",
        f"pieces{number + 1} AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) AS ord, t FROM out{number})",
    ]


def _chunks_sql(limit: int = documents.MAX_TOKENS) -> str:
    steps = ["pieces1 AS MATERIALIZED (SELECT doc_id, CAST(1 AS BIGINT) AS ord, text AS t FROM docs WHERE text <> '')"]
    for number, splitter in enumerate(["chr(10) || chr(10)", "chr(10)", "'. '"], 1):
        steps += _level(number, f"({splitter})", limit)
    steps.append("""chunk_rows AS (SELECT d.condition || '_' || d.file_name || '_' || CAST(ord - 1 AS VARCHAR) AS chunk_id, d.condition,
      d.condition || '/' || d.file_name || '.md' AS source_file, ord - 1 AS chunk_index, p.t AS text
      FROM pieces4 p JOIN docs d USING (doc_id))""")
    return "WITH " + ", ".join(steps)


@query("chunk_documents", with_views(["docs"], _chunks_sql() + " SELECT * FROM chunk_rows", recursive=True))
def chunk_documents(spark, sf_dir):
    return documents.chunk_documents(view(spark, sf_dir, "docs")).drop("tokens")


@query("truncate_budget", with_views(["docs"], _chunks_sql() + f"""
SELECT chunk_id, CAST(tokens AS BIGINT) AS tokens, CAST(running AS BIGINT) AS running_tokens FROM (SELECT chunk_id, {_tokens('text')} AS tokens,
  sum({_tokens('text')}) OVER (PARTITION BY source_file ORDER BY chunk_index) AS running FROM chunk_rows) WHERE running <= {documents.BUDGET}""",
    recursive=True))
def truncate_budget(spark, sf_dir):
    chunks = scale.settle(documents.chunk_documents(view(spark, sf_dir, "docs")).select("chunk_id", "source_file", "chunk_index", "tokens"), "chunks")
    return documents.budget_prefix(chunks, ["source_file"], "chunk_index").select(
        "chunk_id", "tokens", "running_tokens")


@query("concat_ordered", """
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS parts
FROM conversations GROUP BY conv_id""")
def concat_ordered(spark, sf_dir):
    return scale.concat_ordered(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


# Pages of a scanned file: 100 files, each page with up to two image placeholders.
PAGES = {
    "condition": "'c' || CAST(doc_id % 100 % 7 AS STRING)",
    "file_name": "'file_' || CAST(doc_id % 100 AS STRING)",
    "page_no": "CAST((doc_id - doc_id % 100) / 100 AS BIGINT)",
    "markdown": "text || CASE WHEN doc_id % 3 > 0 THEN ' ![img-0](img-0) again ![img-0](img-0)' ELSE '' END "
                "|| CASE WHEN doc_id % 3 > 1 THEN ' ![img-1](img-1)' ELSE '' END",
}
PAGES_SQL = "SELECT doc_id, " + ", ".join(f"{e} AS {a}" for a, e in PAGES.items()) + " FROM documents"


def _link_sql(image: str) -> tuple[str, str]:
    name = f"file_name || '_{image}.png'"
    return f"'![{image}]({image})'", (
        f"'![' || {name} || ']({BASE_URL}/Markdown_Conversions/' || condition || '/Images/' || {name} || ')'")


def _linked_sql() -> str:
    md = "markdown"
    for image in ("img-0", "img-1"):
        old, new = _link_sql(image)
        md = f"replace({md}, {old}, {new})"
    return f"SELECT condition, file_name, page_no, {md} AS markdown, doc_id % 3 AS n_images FROM ({PAGES_SQL})"


def _pages(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", *(f"{e} AS {a}" for a, e in PAGES.items()))
    images = F.slice(F.array(F.lit("img-0"), F.lit("img-1")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return documents.link_images(rows.withColumn("images", images), BASE_URL)


@query("markdown_image_links", _linked_sql())
def markdown_image_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("condition", "file_name", "page_no", "markdown", "n_images")


@query("assemble_pages", f"""
SELECT condition, file_name, string_agg(markdown || chr(10) || chr(10), '' ORDER BY page_no) AS text,
  count(*) AS parts, CAST(sum(n_images) AS BIGINT) AS images_uploaded FROM ({_linked_sql()}) GROUP BY ALL""")
def assemble_pages(spark, sf_dir):
    return documents.assemble_pages(_pages(spark, sf_dir))


def _query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return load(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


A, B = "CAST(embedding AS DOUBLE[])", "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _top_sql(score: str, where: str, k: int) -> str:
    return with_views(["chunks"], f"""SELECT chunk_id, condition, round({score}, 5) AS score FROM chunks {where}
    ORDER BY {score} DESC, chunk_id LIMIT {k}""")


def _shown(frame):
    return frame.select("chunk_id", "condition", F.round("score", 5).alias("score"))


COSINE = f"list_cosine_similarity({A}, {B})"


@query("vector_topk", _top_sql(COSINE, "", 15))
def vector_topk(spark, sf_dir):
    return _shown(vectors.top_k(view(spark, sf_dir, "chunks"), _query_vector(spark, sf_dir)))


@query("vector_topk_filtered", _top_sql(COSINE, "WHERE condition = 'c3'", 50))
def vector_topk_filtered(spark, sf_dir):
    return _shown(vectors.top_k(
        view(spark, sf_dir, "chunks"), _query_vector(spark, sf_dir), ["c3"], vectors.SUMMARY_K))


@query("vector_topk_multi", _top_sql(COSINE, "WHERE condition IN ('c1', 'c2', 'c5')", 15))
def vector_topk_multi(spark, sf_dir):
    return _shown(vectors.top_k(view(spark, sf_dir, "chunks"), _query_vector(spark, sf_dir), ["c1", "c2", "c5"]))


@query("vector_topk_dot", _top_sql(f"list_dot_product({A}, {B})", "", 15))
def vector_topk_dot(spark, sf_dir):
    return _shown(vectors.top_k(
        view(spark, sf_dir, "chunks"), _query_vector(spark, sf_dir), metric="dot"))


@query("vector_topk_l2", _top_sql(f"(-list_distance({A}, {B}))", "", 15))
def vector_topk_l2(spark, sf_dir):
    return _shown(vectors.top_k(
        view(spark, sf_dir, "chunks"), _query_vector(spark, sf_dir), metric="l2"))


def _index(spark, sf_dir, metric: str = "cosine") -> vectors.Index:
    path = scratch.new_dir(spark, "cells")
    vectors.write_index(view(spark, sf_dir, "chunks"), path, 32, metric)
    return vectors.Index(spark, path, metric)


@query("vector_index_topk", _top_sql(COSINE, "", 15))
def vector_index_topk(spark, sf_dir):
    return _shown(_index(spark, sf_dir).top_k(_query_vector(spark, sf_dir)))


@query("vector_index_topk_multi", _top_sql(f"(-list_distance({A}, {B}))", "WHERE condition IN ('c1', 'c2', 'c5')", 15))
def vector_index_topk_multi(spark, sf_dir):
    return _shown(_index(spark, sf_dir, "l2").top_k(_query_vector(spark, sf_dir), ["c1", "c2", "c5"]))


def _per_condition(spark, sf_dir, k: int):
    """Query vector of a condition: its first chunk."""
    chunks = view(spark, sf_dir, "chunks")
    queries = chunks.groupBy("condition").agg(F.min_by("embedding", "chunk_index").alias("query"))
    queries = scale.settle(queries, "queries")
    return vectors.top_k_per_condition(chunks, queries, k)


PER_CONDITION = """q AS (SELECT condition AS qc, arg_min(embedding, chunk_index) AS q FROM chunks GROUP BY condition),
best AS (SELECT chunk_id, condition, chunk_index, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s,
  row_number() OVER (PARTITION BY condition ORDER BY s DESC, chunk_id) AS rank
  FROM chunks JOIN q ON qc = condition QUALIFY rank <= {k})"""


@query("vector_topk_per_condition", with_views(["chunks"], f"""
WITH {PER_CONDITION.format(k=15)} SELECT chunk_id, condition, rank, round(s, 5) AS score FROM best"""))
def vector_topk_per_condition(spark, sf_dir):
    return _per_condition(spark, sf_dir, 15).select(
        "chunk_id", "condition", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("build_context", with_views(["chunks"], f"""
WITH {PER_CONDITION.format(k=50)},
sized AS (SELECT b.condition, b.rank, d.text, sum({_tokens('d.text')}) OVER (PARTITION BY b.condition ORDER BY b.rank) AS running
  FROM best b JOIN documents d ON d.doc_id = b.chunk_index),
ctx AS (SELECT condition, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM sized WHERE running <= 8000 GROUP BY condition)
SELECT condition, CAST(rank AS BIGINT) AS rank, question, 'Question: ' || question || chr(10) || chr(10) || 'Context:' || chr(10) || context AS prompt
FROM ctx, (VALUES {", ".join(f"({r}, '{q}')" for r, q in vocab.SUMMARY_QUESTIONS)}) v(rank, question)"""))
def build_context(spark, sf_dir):
    best = _per_condition(spark, sf_dir, vectors.SUMMARY_K).select("condition", "rank", "chunk_index")
    best = scale.settle(best, "best")
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"), "text")
    kept = documents.budget_prefix(
        texts.join(best, "chunk_index"), ["condition"], "rank", bounded=True)
    context = scale.concat_ordered(kept, ["condition"], "rank", "text", out="context")
    return documents.context_prompts(context)


@query("question_prompt", """
SELECT doc_id, 'Context:' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source AS prompt FROM documents""")
def question_prompt(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", documents.question_prompt(F.col("text"), F.col("source")).alias("prompt"))


# The table holds all conditions but c4. The batch brings c2 to c5 in two versions each; the
# second version of c3 and both of c5 have no vector.
BATCH_SQL = """SELECT chunk_id, condition, source_file, chunk_index, text || ' v' || CAST(version AS VARCHAR) AS text, version
  FROM chunks, (VALUES (1), (2)) v(version)
  WHERE condition IN ('c2', 'c3', 'c4', 'c5') AND NOT (condition = 'c3' AND version = 2) AND condition <> 'c5'"""


def _upsert(spark, sf_dir, replace_document: bool):
    chunks = view(spark, sf_dir, "chunks")
    table = chunks.filter("condition <> 'c4'")
    batch = chunks.filter("condition IN ('c2', 'c3', 'c4', 'c5')").withColumn(
        "version", F.explode(F.array(F.lit(1), F.lit(2))))
    gone = ((F.col("condition") == "c3") & (F.col("version") == 2)) | (F.col("condition") == "c5")
    batch = batch.withColumn("embedding", F.when(gone, F.array().cast("array<float>")).otherwise(F.col("embedding")))
    batch = batch.withColumn("text", F.concat("text", F.lit(" v"), F.col("version").cast("string")))
    return vectors.upsert(table, batch, replace_document=replace_document).drop("embedding")


def _upsert_sql(key: str) -> str:
    return with_views(["chunks"], f"""WITH batch AS ({BATCH_SQL}),
    newest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) = 1)
    SELECT chunk_id, condition, source_file, chunk_index, text FROM chunks
    WHERE condition <> 'c4' AND {key} NOT IN (SELECT {key} FROM newest)
    UNION ALL SELECT chunk_id, condition, source_file, chunk_index, text FROM newest""")


@query("upsert_latest", _upsert_sql("chunk_id"))
def upsert_latest(spark, sf_dir):
    return _upsert(spark, sf_dir, False)


@query("upsert_replace_document", _upsert_sql("source_file"))
def upsert_replace_document(spark, sf_dir):
    return _upsert(spark, sf_dir, True)


@query("chat_roles", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS role FROM conversations WHERE role IN ('user', 'assistant')""")
def chat_roles(spark, sf_dir):
    return chat.map_roles(load(spark, sf_dir, "conversations"), [("user", "human"), ("assistant", "ai")]).drop("text")


STEP = "'Tool: ' || tool || ', Input: ' || tool_input || chr(10) || 'Output: ' || log"
SEP = "chr(10) || '---' || chr(10)"


@query("chat_scratchpad", with_views(["steps"], f"""
SELECT conv_id, string_agg({STEP}, {SEP} ORDER BY turn) AS scratchpad FROM (SELECT * FROM steps
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) WHERE log <> 'TBD' GROUP BY conv_id"""))
def chat_scratchpad(spark, sf_dir):
    return chat.scratchpad(view(spark, sf_dir, "steps"))


@query("chat_full_log", with_views(["steps"], f"""
SELECT conv_id, string_agg({STEP}, {SEP} ORDER BY turn) AS scratchpad, count(*) AS parts
FROM steps WHERE log <> 'TBD' GROUP BY ALL"""))
def chat_full_log(spark, sf_dir):
    return chat.full_log(view(spark, sf_dir, "steps"))
