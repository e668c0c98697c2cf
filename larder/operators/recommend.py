"""Recipe recommendations under condition limits and meal calorie ranges."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import vocab
from larder.functions import text
from larder.operators import members, scale

POOL = 15
PICKS = 5
BASE_COLUMNS = [
    "recipe_name", "image_url", "ingredients", "link", "health_labels", "diet_labels", "caution_labels",
]
ENERGY = "calories_per_serving_kcal"
ANY_RANGE = "any"
# Characters of the pieces by which labels are looked up.
GRAM = 3


def limits_of(condition: str, encourage: bool = False) -> list[tuple[str, str, float]]:
    key = condition.strip().lower()
    return [
        (vocab.LIMIT_ALIASES.get(col, col), ">=" if encourage and (c, col) in vocab.ENCOURAGED else op, bound)
        for c, col, op, bound in vocab.CONDITION_LIMITS
        if c == key
    ]


def within_limits(condition: str, encourage: bool = False) -> Column:
    """Whether a recipe meets a condition; a missing nutrient does not, no condition always does."""
    tests = [
        F.col(col) <= bound if op == "<=" else F.col(col) >= bound
        for col, op, bound in limits_of(condition, encourage)
    ]
    tests += [
        ~text.contains_ci(F.col("caution_labels"), word)
        for c, word in vocab.CONDITION_CAUTIONS
        if c == condition.strip().lower()
    ]
    return F.coalesce(functools.reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def in_meal_range(meal: str) -> Column:
    """Calorie range of a meal; an unknown meal has none."""
    for name, lo, hi in vocab.MEAL_RANGES:
        if name == meal.lower():
            return F.col(ENERGY).between(lo, hi)
    return F.lit(True)


def select_for(condition: str, encourage: bool = False) -> list[str]:
    """Columns shown for a condition: the base columns, energy, then its limited nutrients."""
    nutrients = sorted({col for col, _, _ in limits_of(condition, encourage)} - {ENERGY})
    return [*BASE_COLUMNS, ENERGY, *nutrients]


def matching(
    recipes: DataFrame, condition: str, cuisine: str, meal: str, encourage: bool = False,
    wildcards: bool = False,
) -> DataFrame:
    """All recipes fitting one request, with the columns of its condition.

    `wildcards` reads `%` and `_` in the words as SQL patterns.
    """
    if wildcards:
        words = F.col("cuisine_type").ilike(f"%{cuisine}%") & F.col("meal_type").ilike(f"%{meal}%")
    else:
        words = text.contains_ci(F.col("cuisine_type"), cuisine) & text.contains_ci(F.col("meal_type"), meal)
    fits = words & within_limits(condition, encourage) & in_meal_range(meal)
    return recipes.filter(fits).select(*select_for(condition, encourage))


def first_matching(
    recipes: DataFrame, condition: str, cuisine: str, meal: str, limit: int = POOL
) -> DataFrame:
    return matching(recipes, condition, cuisine, meal).orderBy("recipe_name").limit(limit)


def recipe_conditions(encourage: bool = False, conditions: Sequence[str] = tuple(vocab.CONDITIONS)) -> Column:
    """Array of the conditions a recipe meets; '' stands for having no limits."""
    met = [F.when(within_limits(c, encourage), F.lit(c)) for c in conditions]
    return F.array_compact(F.array(F.lit(""), *met))


def recipe_ranges() -> Column:
    """Array of the meals a recipe can serve, plus the range-free entry for unknown meals."""
    meals = [
        F.when(text.contains_ci(F.col("meal_type"), m) & in_meal_range(m), F.lit(m))
        for m, _, _ in vocab.MEAL_RANGES
    ]
    return F.array_compact(F.array(F.lit(ANY_RANGE), *meals))


def qualify(recipes: DataFrame, encourage: bool = False) -> DataFrame:
    """One row per (recipe, condition met): a narrow expansion instead of a theta join."""
    return recipes.withColumn("condition", F.explode(recipe_conditions(encourage))).filter("condition != ''")


def qualify_by_limits(spark: SparkSession, recipes: DataFrame, encourage: bool = False) -> DataFrame:
    """The same from a limit *table*: nutrients go tall, join their limits, and all must hold.

    Conditions with a caution word instead of limits are added by a filter.
    """
    limits = vocab.condition_limits(spark, encourage)
    names = sorted({vocab.LIMIT_ALIASES.get(col, col) for _, col, _, _ in vocab.CONDITION_LIMITS})
    tall = recipes.select("recipe_name", *names).unpivot(["recipe_name"], names, "nutrient", "amount")
    holds = F.when(F.col("op") == "<=", F.col("amount") <= F.col("bound")).otherwise(
        F.col("amount") >= F.col("bound")
    )
    fitting = (
        tall.join(F.broadcast(limits), "nutrient")
        .groupBy("recipe_name", "condition")
        .agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("fits"))
        .filter("fits").drop("fits")
    )
    for condition, _ in vocab.CONDITION_CAUTIONS:
        free = recipes.filter(within_limits(condition)).select("recipe_name", F.lit(condition).alias("condition"))
        fitting = fitting.unionByName(free)
    return fitting


def _pieces(label: Column, lengths: Column) -> Column:
    """All distinct substrings of a label that have one of the given lengths."""
    size = F.length(label)

    def of_length(n: Column) -> Column:
        starts = F.when((n > 0) & (n <= size), F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(starts, lambda start: F.substring(label, start, n)))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def label_terms(labels: DataFrame, terms: DataFrame, label: str, term: str) -> DataFrame:
    """Pairs of a distinct label and a requested word it contains, without a nested loop.

    Labels are indexed by their pieces of `GRAM` characters (and as short as the words, if those are shorter), so their rows grow
    with the length of the labels alone. A word looks its rarest piece up, and only what it finds there is compared.
    """
    wanted = terms.select(term).filter(F.col(term).isNotNull()).distinct()
    size = F.least(F.length(term), F.lit(GRAM))
    lengths = wanted.agg(F.collect_set(size)).scalar()
    names = labels.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("_lengths", lengths)
    index = names.select(label, F.explode(_pieces(F.lower(label), F.col("_lengths"))).alias("_piece"))
    counts = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    parts = wanted.withColumn("_piece", F.explode(_pieces(F.col(term), F.array(size))))
    rarest = parts.join(counts, "_piece", "left").groupBy(term).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece"))["_piece"].alias("_piece"))
    return rarest.join(index, "_piece").filter(F.contains(F.lower(label), F.col(term))).select(label, term)


def request_rows(requests: DataFrame) -> DataFrame:
    """Requests with word arrays -> one row per (request, cuisine, meal)."""
    return (
        requests.withColumn("cuisine", F.explode("cuisine_types"))
        .withColumn("meal", F.explode("meal_types"))
        .drop("cuisine_types", "meal_types")
        .withColumn("cuisine_term", F.lower("cuisine"))
        .withColumn("meal_term", F.lower("meal"))
    )


def unanswerable(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(username, cuisine, meal, message) for requests of unknown members and for those that name no cuisine or no meal."""
    names = users.select("username").distinct().withColumn("_known", F.lit(True))
    empty = (F.coalesce(F.size("cuisine_types"), F.lit(0)) <= 0) | (F.coalesce(F.size("meal_types"), F.lit(0)) <= 0)
    message = F.when(F.col("_known").isNull(), vocab.UNKNOWN_MEMBER).when(empty, vocab.NOTHING_ASKED)
    nothing = F.lit(None).cast("string")
    return (
        requests.join(names, "username", "left").withColumn("message", message).filter(F.col("message").isNotNull())
        .select("username", nothing.alias("cuisine"), nothing.alias("meal"), "message")
    )


def candidate_classes(recipes: DataFrame, pool: int = POOL, encourage: bool = False) -> DataFrame:
    """First `pool` recipes per (condition, range, cuisine label, meal label).

    The only pass over the recipes. Recipes meeting the same conditions and ranges under the
    same labels stand in for each other, so each task keeps `pool` of every such kind before
    anything is shuffled. Only those are then expanded to the conditions and ranges they meet.
    """
    kinds = ["cuisine_type", "meal_type", "conditions", "ranges"]
    order = [F.col("recipe_name")]
    kept = scale.first_per_key(
        recipes.select(
            "recipe_name", "cuisine_type", "meal_type", ENERGY,
            recipe_conditions(encourage).alias("conditions"), recipe_ranges().alias("ranges"),
        ),
        kinds, order, pool,
    )
    classes = kept.withColumn("limit_key", F.explode("conditions")).withColumn("range_key", F.explode("ranges"))
    keys = ["limit_key", "range_key", "cuisine_type", "meal_type"]
    return scale.first_per_key(classes.drop("conditions", "ranges"), keys, order, pool)


def candidate_pools(classes: DataFrame, wanted: DataFrame, pool: int = POOL) -> DataFrame:
    """First `pool` recipes per condition and wanted (cuisine_term, meal_term), as one array each.

    The requested words meet the few rows of the classes, never the recipes. All conditions
    get a pool, so the requests need not meet their users to tell what is wanted.
    """
    known = [m for m, _, _ in vocab.MEAL_RANGES]
    # Looked at several times, and few, as a rule: with its size known, what it meets stays where it is.
    wanted = scale.settle(wanted.select("cuisine_term", "meal_term").distinct(), "wanted").withColumn(
        "range_key", F.when(F.col("meal_term").isin(known), F.col("meal_term")).otherwise(ANY_RANGE)
    )
    by_cuisine = label_terms(classes, wanted, "cuisine_type", "cuisine_term")
    by_meal = label_terms(classes, wanted, "meal_type", "meal_term")
    pairs = (
        wanted.join(by_cuisine, "cuisine_term").join(by_meal, "meal_term")
        .join(classes, ["cuisine_type", "meal_type", "range_key"])
    )
    keys = ["limit_key", "cuisine_term", "meal_term"]
    # At most `pool` recipes meet in one array.
    return (
        scale.ranked(pairs, keys, [F.col("recipe_name")], pool, "pool_rank")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("pool_rank", "recipe_name", ENERGY))).alias("pool"))
    )


def recommend(
    spark: SparkSession, users: DataFrame, requests: DataFrame, recipes: DataFrame,
    picks: int = PICKS, pool: int = POOL, seed: int | None = None, encourage: bool = False,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Up to `picks` recipes per (user, cuisine, meal), drawn from a pool of `pool`.

    Without a seed the picks are the first by name; with one, every user gets an own
    repeatable draw. `keep_unmatched` keeps combinations without any recipe, with a NULL rank.
    Requests that name nothing or come from unknown members have no combination; `unanswerable` has them.

    The pools of all wanted combinations are settled first. They are as few as there are
    distinct wishes, so the requests usually meet them without being shuffled.
    """
    limited = F.when(F.col("condition").isin(vocab.CONDITIONS), F.col("condition")).otherwise("")
    people = members.conform_condition(spark, users.select("username", "chronic_condition"))
    people = people.select("username", limited.alias("limit_key"))
    rows = request_rows(requests)
    asked = rows.join(people, "username")

    classes = scale.settle(candidate_classes(recipes, pool, encourage), "classes")
    pools = scale.settle(candidate_pools(classes, rows, pool), "pools")
    if seed is None:
        chosen = F.slice("pool", 1, picks)
    else:
        draw = F.transform("pool", lambda r: F.struct(
            text.seeded_order(seed, F.col("username"), r["recipe_name"]).alias("h"), r.alias("r")))
        chosen = F.transform(F.slice(F.sort_array(draw), 1, picks), lambda d: d["r"])
    keys = ["limit_key", "cuisine_term", "meal_term"]
    joined = asked.join(pools, keys, "left" if keep_unmatched else "inner")
    explode = F.posexplode_outer if keep_unmatched else F.posexplode
    return joined.select(
        "username", "limit_key", "cuisine", "meal", explode(chosen).alias("position", "r")
    ).select(
        "username", F.col("limit_key").alias("condition"), "cuisine", "meal",
        (F.col("position") + 1).cast("long").alias("rank"), "r.recipe_name", f"r.{ENERGY}",
    )


def unmatched(recommendations: DataFrame) -> DataFrame:
    """Message rows for combinations without a recipe."""
    return recommendations.filter(F.col("rank").isNull()).select(
        "username", "cuisine", "meal",
        F.format_string(vocab.NO_RECIPES, "meal", "cuisine").alias("message"),
    )


def sample_per_group(rows: DataFrame, keys: Sequence[str], id_column: str, k: int, seed: int) -> DataFrame:
    """Repeatable sample of up to `k` rows per group, by seeded hash order."""
    return scale.first_per_key(rows, keys, [text.seeded_order(seed, F.col(id_column)), F.col(id_column)], k)


def cards(picked: DataFrame, recipes: DataFrame) -> DataFrame:
    """Text card per picked recipe with its condition's nutrients.

    The picks are settled, as they are looked at twice: a card is written once per condition and recipe, from the few
    recipes picked at all, and then joined to the picks.
    """
    picked = scale.settle(picked, "picked")
    columns = sorted({c for name in vocab.CONDITIONS for c in select_for(name)} | {*BASE_COLUMNS, ENERGY})
    details = recipes.select(*columns).join(picked.select("condition", "recipe_name").distinct(), "recipe_name")

    def nutrient_lines(condition: str) -> Column:
        names = [c for c in select_for(condition)[len(BASE_COLUMNS) + 1:]]
        return F.concat(*(
            F.concat(
                F.lit(f"\n{vocab.SYMBOL_DEFAULT} "), text.title_words(F.lit(c)), F.lit(": "),
                F.coalesce(F.col(c).cast("string"), F.lit("N/A")),
            ) for c in names
        ))

    extra = F.lit("")
    for c in vocab.CONDITIONS:
        if len(select_for(c)) > len(BASE_COLUMNS) + 1:
            extra = F.when(F.col("condition") == c, nutrient_lines(c)).otherwise(extra)
    lines = [
        F.concat(F.lit("🍽️ **"), F.col("recipe_name"), F.lit("**")),
        F.concat(F.lit("🔗 [View Recipe]("), F.col("link"), F.lit(")")),
        F.concat(F.lit("📸 ImageURL: "), text.url_without_query(F.col("image_url"))),
        F.concat(F.lit("📝 Ingredients: "), F.col("ingredients")),
        F.concat(F.lit("💡 Health Labels: "), F.col("health_labels")),
        F.concat(F.lit("⚠️ Caution Tags: "), F.col("caution_labels")),
        F.concat(F.lit("🔥 Calories/Serving: "), F.col(ENERGY).cast("string"), F.lit(" kcal")),
    ]
    texts = details.select("condition", "recipe_name", F.concat(F.concat_ws("  \n", *lines), extra, F.lit("\n")).alias("card"))
    return picked.join(texts, ["condition", "recipe_name"]).select(
        "username", "condition", "cuisine", "meal", "rank", "recipe_name", "card")


def card_blocks(card_rows: DataFrame) -> DataFrame:
    """One text per wish: the heading and its cards in order, at most a handful.

    Cards are collected as a set, so a wish that was sent very often stays small.
    """
    rows = card_rows.groupBy("username", "cuisine", "meal").agg(
        F.sort_array(F.collect_set(F.struct("rank", "card"))).alias("rows"))
    return rows.select(
        "username", "cuisine", "meal",
        F.concat(
            F.format_string(vocab.CARD_HEADING, "meal", "cuisine"),
            F.array_join(F.transform("rows", lambda r: r["card"]), "\n"),
        ).alias("block"),
    )


def parse_cards(results: DataFrame, column: str = "result") -> DataFrame:
    """Rendered text -> one row per recipe card: name, calories and the lines to show.

    Cards are told apart by position, as the reader of the text does: the first six are
    breakfast, the next five lunch, the next five dinner, the rest snacks.
    """
    mark = "🍽️"
    blocks = F.split(text.strip(F.col(column)), f"\n\n{mark}")
    rows = results.select("*", F.posexplode(blocks).alias("position", "_block")).drop(column)
    rows = rows.withColumn("_block", F.when(F.col("_block").startswith(mark), F.col("_block")).otherwise(
        F.concat(F.lit(mark), F.col("_block"))))
    lines = F.transform(F.split(text.strip(F.col("_block")), "\n"), text.strip)
    rows = rows.withColumn("_lines", lines)
    heads = F.filter("_lines", lambda x: x.startswith(mark))
    named = F.filter(F.transform(heads, lambda x: text.strip(F.split_part(x, F.lit("**"), F.lit(2)))),
                     lambda x: x != "")
    plain = text.strip(F.replace(F.get(heads, F.lit(0)), F.lit(mark), F.lit("")))
    name = F.coalesce(F.get(named, F.size(named) - 1), plain)
    kcal_lines = F.filter("_lines", lambda x: ~x.startswith(mark) & x.contains("Calories/Serving"))
    last = F.get(kcal_lines, F.size(kcal_lines) - 1)
    kcal = text.strip(F.replace(F.element_at(F.split(last, ":"), -1), F.lit("kcal"), F.lit("")))
    shown = F.filter("_lines", lambda x: ~x.startswith(mark) & ~x.contains("Calories/Serving") & ~x.startswith("📸"))
    return (
        rows.withColumn("recipe_name", name)
        .withColumn("kcal", kcal.try_cast("double"))
        .withColumn("lines", shown)
        .withColumn("meal_type", meal_of_position(F.col("position")))
        .drop("_block", "_lines")
        .filter((F.col("recipe_name") != "") & ~F.lower("recipe_name").startswith("###"))
    )


def meal_of_position(index: Column) -> Column:
    """Meal of a card from its place in the text, counted from zero."""
    return (
        F.when(index < 6, "Breakfast").when(index < 11, "Lunch").when(index < 16, "Dinner").otherwise("Snack")
    )


def highlight(line: Column, condition: Column) -> Column:
    """Bold a line that mentions a nutrient of the condition, led by the first match's symbol."""
    result = line
    for name, words in vocab.HIGHLIGHTS.items():
        marked = line
        for word in reversed(words):
            symbol = vocab.SYMBOLS.get(word, vocab.SYMBOL_DEFAULT)
            marked = F.when(
                text.contains_ci(line, word), F.concat(F.lit(f"**{symbol} "), line, F.lit("**"))
            ).otherwise(marked)
        result = F.when(F.lower(condition) == name, marked).otherwise(result)
    return result
