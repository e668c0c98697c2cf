"""A corpus from raw documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import mixing, neardup, packing, quality, suffixes
from larder.llm.components import handy, keep, only
from larder.llm.queries import find_package, tokenizer_path
from larder.sources import scratch

#: No stage but the first can be said in SQL.
ORACLE_SQL = None
#: Percent of shingles in common from which two documents are near duplicates here; op2's query has its own.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near duplicates; null ids come last.

    Rows are told by id and text, not by id alone: equal rows are one group like other copies, and rows that only share an id,
    or have none, are judged apart. Texts without a word are in no group and stay.
    """
    find_package(spark)
    with only("marks", "repeated"):
        grouped = neardup.near_duplicates(docs, percent=SIMILAR, by_row=True).where("root is not null and n_shingles > 0")
        rows = keep(grouped.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), "group-rows")
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
        marks = rows.join(first, "root").withColumn("stays", F.expr("doc_id <=> first.doc_id and text_key = first.text_key"))
        marks = keep(marks.where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "stays"), "marks")
        repeated = keep(marks.where("stays").drop("stays"), "repeated")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    alone = docs.join(handy(marks), on, "left_anti")
    equal = docs.join(handy(repeated), on).groupBy("_id", "_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return alone.unionByName(equal.select("row.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of more than 50 words that repeat; a document of which nothing is left goes.

    The stage has a length of its own: the 400 bytes of op4's query are longer than many such passages.
    """
    find_package(spark)
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    rest = suffixes.remove_repeats(docs, length=suffixes.WORDS, units=suffixes.WordRuns, carry=carry)
    rest = rest.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return rest.where("trim(translate(text, '\\t\\n\\r', '   ')) <> ''").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    find_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage reads what the one before has written."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch.new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            scratch.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
