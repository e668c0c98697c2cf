"""Recipe ingestion: nested records to tall rows to one wide row, incrementally."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import vocab
from larder.functions import numbers, text
from larder.operators import scale

if TYPE_CHECKING:
    import pandas as pd

# Offers that one task may walk through one by one.
ONE_TASK = 2_000_000
LABEL_COLUMNS = ("cuisine_type", "meal_type", "dish_type", "ingredients", "health_labels", "diet_labels", "caution_labels")


def explode_hits(pages: DataFrame, order: str | None = None) -> DataFrame:
    """API result pages -> one row per recipe, with `hit_rank` where the column `order` orders the pages."""
    if order is None:
        return pages.select(F.explode("hits").alias("hit")).select("hit.recipe.*")
    rows = pages.select(F.col(order).alias("page"), F.posexplode("hits").alias("position", "hit"))
    return rows.select(F.struct("page", "position").alias("hit_rank"), "hit.recipe.*")


def with_slug(recipes: DataFrame) -> DataFrame:
    return recipes.withColumn("recipe_name", text.slug(F.col("label")))


def _servings() -> Column:
    return F.coalesce(F.col("yield"), F.lit(1.0))


def per_serving(recipes: DataFrame) -> DataFrame:
    """Calories per serving and share of a 2000 kcal day; a zero yield gives NULL."""
    kcal = F.try_divide(F.coalesce(F.col("calories"), F.lit(0.0)), _servings())
    return recipes.select(
        "*",
        _servings().alias("servings"),
        kcal.alias("calories_per_serving"),
        numbers.round_binary(kcal).cast("long").alias("kcal_rounded"),
        numbers.round_binary(kcal / F.lit(vocab.DAILY_KCAL) * 100.0, 1).alias("daily_value_pct"),
    )


def recipe_rejects(recipes: DataFrame) -> DataFrame:
    """Recipes whose yield cannot be divided by."""
    return recipes.filter(_servings() == 0).withColumn("reason", F.lit("yield is zero"))


def unpivot_nutrients(recipes: DataFrame) -> DataFrame:
    """Nested recipes -> (recipe_name, position, attribute, value, unit), one narrow pass."""
    ready = per_serving(with_slug(recipes).filter(_servings() != 0))

    def row(name: Column, value: Column, unit: Column) -> Column:
        return F.struct(name.alias("attribute"), value.cast("string").alias("value"), unit.alias("unit"))

    nutrients = F.transform(
        F.filter(
            F.map_entries(F.coalesce(F.col("totalNutrients"), F.create_map().cast(
                recipes.schema["totalNutrients"].dataType))),
            lambda e: e["key"] != vocab.ENERGY_KEY,
        ),
        lambda e: row(
            e["value"]["label"],
            numbers.round_binary(e["value"]["quantity"] / F.col("servings"), 2),
            e["value"]["unit"],
        ),
    )
    metrics = F.array(
        row(F.lit("Servings"), F.col("servings"), F.lit("-")),
        row(F.lit("Calories per Serving"), F.col("kcal_rounded"), F.lit("kcal")),
        row(F.lit("Daily Value %"), F.col("daily_value_pct"), F.lit("%")),
    )
    labels = F.filter(
        F.array(*(
            F.when(F.size(field) > 0, row(F.lit(name), F.array_join(field, "; "), F.lit("-")))
            for field, name in vocab.LABEL_FIELDS
        )),
        lambda r: r.isNotNull(),
    )
    links = F.array(
        row(F.lit("Link"), F.coalesce(F.col("url"), F.lit("")), F.lit("-")),
        row(F.lit("Image URL"), F.coalesce(F.col("image"), F.lit("")), F.lit("-")),
    )
    return ready.select(
        "recipe_name", F.posexplode(F.concat(nutrients, metrics, labels, links)).alias("position", "r")
    ).select("recipe_name", "position", "r.attribute", "r.value", "r.unit")


def pivot_eav(raw: DataFrame, numeric_max: bool = False) -> DataFrame:
    """(recipe_name, attribute, value) -> one wide row per recipe in a single aggregate.

    A repeated attribute keeps its largest *string*, as casting happens after the maximum;
    `numeric_max` casts first. Numbers that do not parse become NULL (see `pivot_rejects`).
    """
    def pick(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("_attribute") == name, value))

    value = F.col("value")
    texts = [F.coalesce(pick(a, value), F.lit("N/A")).alias(c) for a, c in vocab.TEXT_ATTRIBUTES]
    if numeric_max:
        figures = [pick(a, value.try_cast("double")).alias(c) for a, c in vocab.NUMBER_ATTRIBUTES]
    else:
        figures = [pick(a, value).try_cast("double").alias(c) for a, c in vocab.NUMBER_ATTRIBUTES]
    return raw.withColumn("_attribute", F.lower("attribute")).groupBy("recipe_name").agg(*texts, *figures)


def label_lists(table: DataFrame, columns: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    """The joined label texts as arrays; 'N/A' is an empty array."""
    return table.withColumns({
        c: F.when(F.col(c) == "N/A", F.array().cast("array<string>")).otherwise(F.split(c, "; ")) for c in columns
    })


def pivot_rejects(raw: DataFrame) -> DataFrame:
    """Values of numeric attributes that are no numbers."""
    names = [a for a, _ in vocab.NUMBER_ATTRIBUTES]
    return raw.filter(
        F.lower("attribute").isin(names)
        & F.col("value").isNotNull()
        & F.col("value").try_cast("double").isNull()
    )


def keys_not_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is NOT IN `known`, with SQL's NULL rules and no broadcast.

    One NULL among the known keys excludes everything, and so does a NULL key of its own
    unless nothing is known.
    """
    null_key = F.col(key).isNull()
    # 2: nothing is known, 0: a NULL is, 1: neither. A NULL key of its own needs 2, others 1.
    verdict = known.agg(
        F.when(F.count(F.lit(1)) == 0, 2).when(F.count_if(null_key) > 0, 0).otherwise(1).alias("verdict")
    ).scalar()
    return rows.filter(verdict >= F.when(null_key, 2).otherwise(1)).join(
        known.select(key).distinct(), key, "left_anti")


def new_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is not known yet; NULL keys never count as known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def pivot_new(raw: DataFrame, known: DataFrame, numeric_max: bool = False) -> DataFrame:
    """Wide rows of the recipes that are not known yet.

    The pivot comes first: it shrinks every recipe to one row before the shuffle that the
    anti join then shares, so a recipe with very many rows does no harm.
    """
    return new_keys(pivot_eav(raw, numeric_max), known, "recipe_name")


def ledger_union(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    return ledger.unionByName(keys).distinct()


def cap_first_wins(hits: DataFrame, cap: int = vocab.CUISINE_CAP) -> DataFrame:
    """Each slug goes to its first cuisine, then every cuisine keeps its first `cap`.

    `hits` has (cuisine_rank, hit_rank, slug), less the slugs of the ledger (`new_keys`). A slug
    beyond the cap is not offered to later cuisines; `cap_exact` does that.
    """
    unique = scale.first_per_key(hits, ["slug"], [F.col("cuisine_rank"), F.col("hit_rank")])
    return scale.ranked(unique, ["cuisine_rank"], [F.col("hit_rank"), F.col("slug")], cap, "pick")


def cap_exact(hits: DataFrame, cuisines: int, cap: int = vocab.CUISINE_CAP) -> DataFrame:
    """What a walk over the cuisines in order takes: up to `cap` slugs each that nobody took before.

    Earlier cuisines take at most `cap * (cuisines - 1)` slugs, so the first `cap * cuisines` distinct slugs of a cuisine
    decide its result whatever was taken. These offers, at most `cap * cuisines ** 2` rows however many hits there
    are, are walked through in one task; if the parameters allow more than `ONE_TASK` of them, in rounds.
    """
    need = cap * cuisines
    unique = hits.groupBy("cuisine_rank", "slug").agg(F.min("hit_rank").alias("hit_rank"))
    order = [F.col("hit_rank"), F.col("slug")]
    shard = F.pmod(F.xxhash64("slug"), F.lit(256))
    short = scale.first_per_key(unique.withColumn("_shard", shard), ["cuisine_rank", "_shard"], order, need)
    short = scale.first_per_key(short.drop("_shard"), ["cuisine_rank"], order, need).select("cuisine_rank", "slug", "hit_rank")
    return _cap_in_rounds(short, cap) if need * cuisines > ONE_TASK else _cap_in_order(short, cap)


def _cap_in_order(offers: DataFrame, cap: int) -> DataFrame:
    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, cuisine, n = set(), None, 0
        for part in parts:
            picks = []
            for at, slug in zip(part["cuisine_rank"], part["slug"], strict=True):
                cuisine, n = (cuisine, n) if at == cuisine else (at, 0)
                good = n < cap and slug not in taken
                if good:
                    taken.add(slug)
                    n += 1
                picks.append(n if good else 0)
            part["pick"] = picks
            yield part[part["pick"] > 0]

    kinds = dict(offers.dtypes)
    rows = offers.repartition(1).sortWithinPartitions("cuisine_rank", "hit_rank", "slug")
    return rows.mapInPandas(walk, ", ".join(f"{c} {kinds[c]}" for c in offers.columns) + ", pick int")


def _cap_in_rounds(offers: DataFrame, cap: int) -> DataFrame:
    """All cuisines choose at once, round by round: each takes its first `cap` slugs that no earlier one took in the round before.

    After round i at least the first i cuisines have what the walk gives them, and a round that changes nothing is
    the walk's result.
    """
    order = [F.col("hit_rank"), F.col("slug")]
    short = scale.settle(offers, "offers")
    picks, last = scale.settle(scale.ranked(short, ["cuisine_rank"], order, cap, "pick"), "picks"), None
    while (mark := _fingerprint(picks)) != last:
        taken = picks.groupBy("slug").agg(F.min("cuisine_rank").alias("_by"))
        left = short.join(taken, "slug", "left").filter("_by is null or _by >= cuisine_rank").drop("_by")
        picks, last = scale.settle(scale.ranked(left, ["cuisine_rank"], order, cap, "pick"), "picks"), mark
    return picks.select("cuisine_rank", "slug", "hit_rank", "pick")


def _fingerprint(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())


def count_per_group(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def quality_checks(
    table: DataFrame, not_null: Sequence[str] = ("recipe_name", "servings", "calories_per_serving_kcal"),
    unique: Sequence[str] = ("recipe_name",),
) -> DataFrame:
    """One row per data test: (test, column_name, failures).

    NULLs are counted per value of the first unique column, so that test and the NULL tests
    share one pass.
    """
    results = []
    for i, column in enumerate(unique):
        counted = list(not_null) if i == 0 else []
        per_value = table.groupBy(F.col(column).alias("_value")).agg(
            F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in counted)
        )
        totals = per_value.agg(
            F.count_if(F.col("_value").isNotNull() & (F.col("_n") > 1)).alias("unique"),
            *(F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in counted),
        )
        tests = [("unique", column, "unique"), *(("not_null", c, f"null_{c}") for c in counted)]
        results.append(totals.select(F.inline(F.array(*(
            F.struct(F.lit(test).alias("test"), F.lit(name).alias("column_name"), F.col(source).alias("failures"))
            for test, name, source in tests
        )))))
    return functools.reduce(DataFrame.unionByName, results)


def image_key(slug: Column, mime: Column) -> Column:
    """Object key of a recipe image; an unknown content type is stored as `.jpg`."""
    chain = functools.reduce(
        lambda acc, pair: acc.when(mime == pair[0], pair[1]),
        vocab.MIME_EXTENSIONS[1:],
        F.when(mime == vocab.MIME_EXTENSIONS[0][0], vocab.MIME_EXTENSIONS[0][1]),
    )
    return F.concat(F.lit("Recipe_EDA/"), slug, F.lit("/Images/image"), chain.otherwise(vocab.MIME_DEFAULT))


def target_nutrients(details: DataFrame) -> DataFrame:
    """Nested nutrient list -> map of the target nutrients as `amount unit`; the last repeat wins."""
    kept = F.filter("nutrition.nutrients", lambda n: n["name"].isin(vocab.TARGET_NUTRIENTS))
    names = F.array_distinct(F.transform(kept, lambda n: n["name"]))
    latest = F.transform(
        names, lambda name: F.element_at(F.filter(kept, lambda n: n["name"] == name), -1)
    )
    formatted = F.transform(latest, lambda n: F.concat_ws(" ", n["amount"].cast("string"), n["unit"]))
    return details.withColumn("nutrients", F.map_from_arrays(names, formatted))


def amount_of(formatted: Column) -> Column:
    """`12.5 g` -> 12.5"""
    return F.split_part(formatted, F.lit(" "), F.lit(1)).try_cast("double")


def recipe_steps(details: DataFrame) -> DataFrame:
    """Ordered steps of the first instruction block; recipes without one keep a NULL row."""
    steps = F.get("analyzedInstructions", F.lit(0))["steps"]
    return details.select("title", F.posexplode_outer(steps).alias("position", "s")).select(
        "title", "position", F.col("s.number").alias("number"), F.col("s.step").alias("step")
    )


def recipe_ingredients(details: DataFrame) -> DataFrame:
    return details.select("title", F.posexplode("extendedIngredients").alias("position", "i")).select(
        "title", "position", F.col("i.original").alias("ingredient")
    )


def append_new(
    spark: SparkSession, rows: DataFrame, path: str, key: str, full_refresh: bool = False
) -> None:
    """Incremental table: append rows whose key the table does not hold yet."""
    from larder.sources import files

    if full_refresh or not files.exists(spark, path):
        rows.write.mode("overwrite").parquet(path)
        return
    known = spark.read.schema(rows.schema).parquet(path)
    new_keys(rows, known, key).write.mode("append").parquet(path)
