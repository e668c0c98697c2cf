"""Documents: page assembly, token-bounded chunks, budgeted context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larder import vocab
from larder.functions import text
from larder.operators import scale

SPLITTERS = ["\n\n", "\n", ". "]
MAX_TOKENS = 300
BUDGET = 8000


def _piece(body: Column, tokens: Column) -> Column:
    return F.struct(body.alias("t"), tokens.cast("int").alias("n"))


def _pack(piece: Column, splitter: str, max_tokens: int) -> Column:
    """Split one piece and pack neighbours greedily up to the token limit.

    Blanks separate tokens and every splitter contains one, so the count of two joined
    parts is the sum of their counts; it is carried along instead of counted again. If a
    blank splitter packs everything into one, the piece fits and stays as it was.
    """
    parts = F.transform(
        F.split(piece["t"], splitter.replace(".", r"\.")),
        lambda p: _piece(p, text.token_count(p)),
    )
    start = F.struct(
        F.array().cast("array<struct<t:string,n:int>>").alias("done"), _piece(F.lit(""), F.lit(0)).alias("open")
    )

    def flush(acc: Column) -> Column:
        return F.when(acc["open"]["t"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, part: Column) -> Column:
        current = acc["open"]
        total = current["n"] + part["n"]
        joined = text.strip(
            F.when(current["t"] == "", part["t"]).otherwise(F.concat(current["t"], F.lit(splitter), part["t"]))
        )
        fits = total <= max_tokens
        return F.struct(
            F.when(fits, acc["done"]).otherwise(flush(acc)).alias("done"),
            F.when(fits, _piece(joined, total)).otherwise(_piece(text.strip(part["t"]), part["n"])).alias("open"),
        )

    def finish(acc: Column) -> Column:
        if splitter.strip():
            return flush(acc)
        whole = (F.size(acc["done"]) == 0) & (acc["open"]["n"] <= max_tokens)
        return F.when(whole, F.array(_piece(piece["t"], acc["open"]["n"]))).otherwise(flush(acc))

    return F.aggregate(parts, start, step, finish)


def split_text(body: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Array of chunks (t: text, n: tokens): whole text if it fits, else blocks, else lines, else sentences.

    A packed chunk within the limit is final. A chunk above it is a single part that no
    earlier splitter divides, so one level per splitter is enough. A part that nothing
    divides stays whole.

    A NULL count means not counted yet. Splitters that are all blank add no token, so their
    parts' counts give the count of the whole; before sentences it has to be known, as the
    full stops of empty sentences are tokens.
    """
    def divide(splitter: str):
        return lambda piece: F.when(
            (piece["n"].isNull() | (piece["n"] > max_tokens)) & piece["t"].contains(splitter),
            _pack(piece, splitter, max_tokens),
        ).otherwise(F.array(piece))

    pieces = F.array(_piece(body, F.lit(None)))
    for splitter in SPLITTERS:
        if splitter.strip():
            pieces = F.transform(
                pieces, lambda piece: _piece(piece["t"], F.coalesce(piece["n"], text.token_count(piece["t"]))))
        pieces = F.flatten(F.transform(pieces, divide(splitter)))
    return pieces


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(condition, file_name, text) -> chunk rows; documents without text are skipped."""
    return (
        docs.filter(text.non_blank(F.col("text")))
        .select("condition", "file_name", F.posexplode(split_text(F.col("text"), max_tokens)).alias("chunk_index", "piece"))
        .select(
            F.concat_ws("_", "condition", "file_name", F.col("chunk_index").cast("string")).alias("chunk_id"),
            "condition",
            F.concat("condition", F.lit("/"), "file_name", F.lit(".md")).alias("source_file"),
            F.col("chunk_index").cast("long").alias("chunk_index"),
            F.col("piece.t").alias("text"),
            F.col("piece.n").cast("long").alias("tokens"),
        )
    )


def name_parts(files: DataFrame, column: str = "path") -> DataFrame:
    """File path -> file, name without extension, condition prefix."""
    file = text.base_name(F.col(column))
    return files.select(
        "*", file.alias("file"), text.without_extension(file).alias("stem"), text.file_prefix(file).alias("condition")
    )


def link_images(pages: DataFrame, base_url: str) -> DataFrame:
    """Rewrite image placeholders of a page's Markdown to stored image links.

    A page has `images`, an array of image ids, beside (condition, file_name, markdown).
    """
    def link(md: Column, image: Column) -> Column:
        name = F.concat("file_name", F.lit("_"), image, F.lit(".png"))
        url = F.concat(F.lit(base_url), F.lit("/Markdown_Conversions/"), "condition", F.lit("/Images/"), name)
        return F.replace(
            md,
            F.concat(F.lit("!["), image, F.lit("]("), image, F.lit(")")),
            F.concat(F.lit("!["), name, F.lit("]("), url, F.lit(")")),
        )

    return pages.withColumn("markdown", F.aggregate("images", F.col("markdown"), link)).withColumn(
        "n_images", F.size("images").cast("long")
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages -> Markdown per file, every page followed by a blank line, and its image count."""
    linked = pages.withColumn("markdown", F.concat("markdown", F.lit("\n\n")))
    return scale.concat_ordered(
        linked, ["condition", "file_name"], "page_no", "markdown", "", totals=["n_images"]
    ).withColumnRenamed("n_images", "images_uploaded")


def budget_prefix(
    chunks: DataFrame, keys: Sequence[str], position: str, budget: int = BUDGET, column: str = "text",
    bounded: bool = False,
) -> DataFrame:
    """Leading chunks of each key while the running token count stays within the budget.

    Counts are never negative, so stopping at the first overflow and keeping every prefix
    sum within the budget are the same. `bounded` says that no key has many chunks, as after
    a top-k; otherwise a key is summed up in blocks of 256 positions.
    """
    counted = chunks
    if "tokens" not in chunks.columns:
        counted = chunks.withColumn("tokens", text.token_count(F.col(column)).cast("long"))
    blocks = [] if bounded else [F.floor(F.col(position) / 256), F.floor(F.col(position) / 65536)]
    return scale.running_sum(counted, keys, [position], "tokens", blocks, "running_tokens").filter(F.col("running_tokens") <= budget)


def context_prompts(contexts: DataFrame) -> DataFrame:
    """Seven question prompts per condition context."""
    rows = F.array(*(
        F.struct(F.lit(rank).cast("long").alias("rank"), F.lit(q).alias("question"))
        for rank, q in vocab.SUMMARY_QUESTIONS
    ))
    return contexts.select("condition", "context", F.inline(rows)).select(
        "condition", "rank", "question",
        F.concat(F.lit("Question: "), "question", F.lit("\n\nContext:\n"), "context").alias("prompt"),
    )


def question_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n\n"), context, F.lit("\n\nQuestion: "), question)
