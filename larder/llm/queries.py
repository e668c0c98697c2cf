"""The registered queries of this package and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import clustering, extraction, mixing, neardup, ordinal, packing, pitmanyor, quality, revisits, sketches, suffixes, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def find_package(spark: SparkSession) -> None:
    """Let Python workers that don't have this library installed find it where the driver has."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extraction.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for all documents."""
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"m.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeat; and how many of their words lie in passages of more than 50 that repeat."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False, passages=suffixes.WORDS)


def tokenizer_path() -> str:
    """The contract's tokenizer file; it lies in an installed package of every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified captures derived from all pages, resolved."""
    resolved = revisits.resolve(revisits.captures_of(_table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", revisits.header_text("headers"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return sketches.edited_likeness(_table(spark, sf_dir, "documents"))


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail chances of all documents; grades are 0 (poor), 1 (good but toxic), 2 (good)."""
    labels = _table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2)).when(F.col("quality") == 0, 0)
    return ordinal.graded(_table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")))


def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters."""
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of all documents under a hierarchical Pitman-Yor model of nine tenths of them."""
    return pitmanyor.score(_table(spark, sf_dir, "documents"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors projected on their 16 leading components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_dom_trees": op1_dom_trees,
    "op2_superminhash": op2_superminhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_levels": op4_suffix_levels,
    "op5_vector_packing": op5_vector_packing,
    "op6_water_filling": op6_water_filling,
    "op7_noisy_channel": op7_noisy_channel,
    "op8_revisits": op8_revisits,
    "op9_bottom_k": op9_bottom_k,
    "op10_ordinal": op10_ordinal,
    "op11_shallot": op11_shallot,
    "op12_pitman_yor": op12_pitman_yor,
    "op13_block_whitening": op13_block_whitening,
}

SQL: dict[str, str] = {
    "op3_quality_rules": quality.sql(),
    "op6_water_filling": mixing.sql(),
    "op8_revisits": revisits.SQL,
    "op11_shallot": clustering.sql(),
}


def all_queries() -> dict[str, Query]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}
