"""The four end-to-end jobs, each a composition of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import vocab
from larder.operators import documents, nutrition, recipes, recommend, scale, vectors
from larder.sources import files


def refresh_recipes(
    spark: SparkSession, json_path: str, csv_path: str, table_path: str, ledger_path: str,
    cap: int = vocab.CUISINE_CAP,
) -> DataFrame:
    """Nested recipes -> CSV per recipe -> wide table -> data tests.

    Recipes already in the ledger are skipped. Cuisines, in order of their names, take up to `cap`
    new recipes each that no cuisine before took, in order of pages (by path) and hits; the
    first hit of a name within its cuisine counts. Every step writes before the next reads, and a run that is
    repeated finds nothing new. Returns the data tests of the whole table.
    """
    found = recipes.with_slug(recipes.explode_hits(files.read_recipe_json(spark, json_path, "page"), "page"))
    found = found.withColumn("cuisine", F.coalesce(F.get("cuisineType", F.lit(0)), F.lit("")))
    fresh = recipes.new_keys(found, files.read_ledger(spark, ledger_path).withColumnRenamed("slug", "recipe_name"), "recipe_name")
    # Settled, as the ledger it was compared with grows below.
    fresh = scale.settle(scale.first_per_key(fresh, ["cuisine", "recipe_name"], [F.col("hit_rank")]), "fresh")
    offers = fresh.select(F.col("cuisine").alias("cuisine_rank"), "hit_rank", F.col("recipe_name").alias("slug"))
    cuisines = fresh.select("cuisine").distinct().count()
    picks = recipes.cap_exact(offers, max(1, cuisines), cap).select(
        F.col("cuisine_rank").alias("cuisine"), F.col("slug").alias("recipe_name"))
    fresh = scale.settle(fresh.join(picks, ["cuisine", "recipe_name"], "left_semi").drop("hit_rank", "cuisine"), "taken")
    tall = recipes.unpivot_nutrients(fresh)
    files.write_recipe_csvs(tall, csv_path)
    wide = recipes.pivot_eav(tall.select("recipe_name", "attribute", "value"))
    recipes.append_new(spark, wide, table_path, "recipe_name")
    files.append_ledger(fresh.select(F.col("recipe_name").alias("slug")), ledger_path)
    return recipes.quality_checks(files.read_table(spark, table_path, wide.schema))


def answer_wishes(
    spark: SparkSession, users: DataFrame, requests: DataFrame, table: DataFrame, seed: int | None = None
) -> DataFrame:
    """One text per wish: its recipe cards, or the message that there are none."""
    rows = scale.settle(recommend.recommend(spark, users, requests, table, seed=seed, keep_unmatched=True), "wishes")
    shown = recommend.card_blocks(recommend.cards(rows.filter(F.col("rank").isNotNull()), table))
    return shown.unionByName(recommend.unmatched(rows).withColumnRenamed("message", "block").distinct())


def condition_context(
    chunks: DataFrame, query: Sequence[float], condition: str, k: int = vectors.SUMMARY_K,
    budget: int = documents.BUDGET,
) -> DataFrame:
    """Question prompts over the closest chunks of a condition, as many as the budget holds."""
    # At most `k` rows from here on.
    best = scale.settle(vectors.top_k(chunks, query, [condition], k), "best")
    ranked = scale.ranked(best, ["condition"], [F.desc("score"), F.col("chunk_id")], k)
    kept = documents.budget_prefix(ranked, ["condition"], "rank", budget, bounded=True)
    return documents.context_prompts(scale.concat_ordered(kept, ["condition"], "rank", "text", out="context"))


def alerts(users: DataFrame, logs: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The four messages of a day."""
    return {
        "daily": nutrition.message_daily(nutrition.daily_summary(users, logs, as_of), as_of),
        "low_logging": nutrition.message_low_logging(nutrition.low_logging(users, logs, as_of)),
        "weekly": nutrition.message_weekly(nutrition.weekly_digest(users, logs, as_of), as_of),
        "critical": nutrition.message_critical(nutrition.critical_low(users, logs, as_of)),
    }
