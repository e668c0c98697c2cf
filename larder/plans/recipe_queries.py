"""Recipe ingestion, pivot, increments and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import vocab
from larder.functions import text
from larder.operators import documents, recipes
from larder.plans.registry import query
from larder.plans.views import EAV_NAME, P, load, raw_recipes, view, with_views
from larder.sources import schemas

LABEL = "chr(9) || '  ' || upper(p_name) || '/' || p_type || ' ' || CAST(p_size AS STRING) || '  '"
SLUG = "replace(replace(lower(trim({0}, ' ' || chr(9))), ' ', '_'), '/', '_')"


@query("slug_normalize", f"SELECT p_partkey, {SLUG.format(LABEL)} AS recipe_name FROM part")
def slug_normalize(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey", f"{LABEL} AS label")
    return recipes.with_slug(rows).select("p_partkey", "recipe_name")


# Nested recipe of a part, as JSON text; quantities are whole or quarter numbers.
YIELD = f"{P} % 9"
KCAL = f"(200 + ({P} * 37) % 3000)"
FAT = f"(({P} * 13) % 400)"
NAMED = f"p_name || '/' || CAST({P} AS STRING)"


def _json(text_of_key: str) -> str:
    return f"""'{{"recipe":{{"label":"' || p_name || '/' || {text_of_key} || '","url":"http://example.org/r/' || {text_of_key} || '",'
      || '"image":"http://example.org/i/' || {text_of_key} || '.jpg","yield":' || CAST({YIELD} AS STRING)
      || ',"calories":' || CAST({KCAL} AS STRING)
      || CASE WHEN {P} % 10 = 3 THEN '' ELSE ',"totalNutrients":{{"ENERC_KCAL":{{"label":"Energy","quantity":1,"unit":"kcal"}},'
      || '"FAT":{{"label":"Fat","quantity":' || CAST({FAT} AS STRING) || '.25,"unit":"g"}},'
      || '"NA":{{"label":"Sodium","quantity":' || CAST(p_size AS STRING) || ',"unit":"mg"}}}}' END
      || ',"healthLabels":["' || p_brand || '","' || p_type || '"],"dietLabels":[],'
      || '"mealType":["lunch/dinner"],"ingredientLines":["' || p_name || '"]}}}}'"""


def _pages(spark, sf_dir):
    key = f"CAST({P} AS STRING)"
    body = "'{\"hits\":[' || " + _json(key) + " || ']}'"
    rows = load(spark, sf_dir, "part").selectExpr(f"{body} AS body")
    return rows.select(F.from_json("body", schemas.RECIPE_PAGE).alias("page")).select("page.*")


@query("src_recipe_json", f"""
SELECT {NAMED} AS label, CAST({YIELD} AS DOUBLE) AS servings, CAST({KCAL} AS DOUBLE) AS calories,
  CASE WHEN {P} % 10 = 3 THEN NULL ELSE CAST({FAT} AS DOUBLE) + 0.25E0 END AS fat,
  p_brand || '; ' || p_type AS health FROM part""")
def src_recipe_json(spark, sf_dir):
    return recipes.explode_hits(_pages(spark, sf_dir)).select(
        "label", F.col("yield").alias("servings"), "calories",
        F.try_element_at("totalNutrients", F.lit("FAT"))["quantity"].alias("fat"),
        F.array_join("healthLabels", "; ").alias("health"),
    )


NESTED = f"""(SELECT {SLUG.format(NAMED)} AS recipe_name, CAST({YIELD} AS DOUBLE) AS y, CAST({KCAL} AS DOUBLE) AS kcal,
  CAST({FAT} AS DOUBLE) + 0.25E0 AS fat, CAST(p_size AS DOUBLE) AS sodium, * FROM part)"""


@query("per_serving", f"""
SELECT recipe_name, kcal / nullif(y, 0) AS calories_per_serving, CAST(printf('%.0f', kcal / nullif(y, 0)) AS BIGINT) AS kcal_rounded,
  CAST(printf('%.1f', kcal / nullif(y, 0) / 2000.0E0 * 100.0E0) AS DOUBLE) AS daily_value_pct FROM {NESTED} WHERE y > 0
UNION ALL SELECT recipe_name, NULL, NULL, NULL FROM {NESTED} WHERE y = 0""")
def per_serving(spark, sf_dir):
    return recipes.per_serving(recipes.with_slug(recipes.explode_hits(_pages(spark, sf_dir)))).select(
        "recipe_name", "calories_per_serving", "kcal_rounded", "daily_value_pct")


@query("recipe_rejects", f"SELECT {NAMED} AS label, 'yield is zero' AS reason FROM part WHERE {YIELD} = 0")
def recipe_rejects(spark, sf_dir):
    return recipes.recipe_rejects(recipes.explode_hits(_pages(spark, sf_dir))).select("label", "reason")


def _number(expr: str, digits: int) -> str:
    """Shortest text of a rounded double, as in `12.5` or `3.0`."""
    return f"CAST(CAST(printf('%.{digits}f', {expr}) AS DOUBLE) AS VARCHAR)"


@query("unpivot_nutrients", f"""
WITH n AS (SELECT * FROM {NESTED} WHERE y <> 0)
SELECT recipe_name, 'Fat' AS attribute, {_number('fat / y', 2)} AS "value", 'g' AS unit FROM n WHERE {P} % 10 <> 3
UNION ALL SELECT recipe_name, 'Sodium', {_number('sodium / y', 2)}, 'mg' FROM n WHERE {P} % 10 <> 3
UNION ALL SELECT recipe_name, 'Servings', CAST(y AS VARCHAR), '-' FROM n
UNION ALL SELECT recipe_name, 'Calories per Serving', printf('%.0f', kcal / y), 'kcal' FROM n
UNION ALL SELECT recipe_name, 'Daily Value %', {_number('kcal / y / 2000.0E0 * 100.0E0', 1)}, '%' FROM n
UNION ALL SELECT recipe_name, 'Health Labels', p_brand || '; ' || p_type, '-' FROM n
UNION ALL SELECT recipe_name, 'Meal Type', 'lunch/dinner', '-' FROM n
UNION ALL SELECT recipe_name, 'Ingredients', p_name, '-' FROM n
UNION ALL SELECT recipe_name, 'Link', 'http://example.org/r/' || CAST({P} AS VARCHAR), '-' FROM n
UNION ALL SELECT recipe_name, 'Image URL', 'http://example.org/i/' || CAST({P} AS VARCHAR) || '.jpg', '-' FROM n""")
def unpivot_nutrients(spark, sf_dir):
    return recipes.unpivot_nutrients(recipes.explode_hits(_pages(spark, sf_dir))).drop("position")


def _pivot_sql(numeric_max: bool, source: str = "raw_recipes") -> str:
    texts = [
        f"coalesce(max(CASE WHEN lower(attribute) = '{a}' THEN \"value\" END), 'N/A') AS {c}"
        for a, c in vocab.TEXT_ATTRIBUTES
    ]
    form = "max(CASE WHEN lower(attribute) = '{0}' THEN TRY_CAST(\"value\" AS DOUBLE) END) AS {1}" if numeric_max else (
        "TRY_CAST(max(CASE WHEN lower(attribute) = '{0}' THEN \"value\" END) AS DOUBLE) AS {1}")
    numbers = [form.format(a, c) for a, c in vocab.NUMBER_ATTRIBUTES]
    return f"SELECT recipe_name, {', '.join(texts + numbers)} FROM {source} GROUP BY recipe_name"


@query("pivot_eav", with_views(["raw_recipes"], _pivot_sql(False)))
def pivot_eav(spark, sf_dir):
    return recipes.pivot_eav(raw_recipes(spark, sf_dir))


@query("pivot_eav_numeric_max", with_views(["raw_recipes"], _pivot_sql(True)))
def pivot_eav_numeric_max(spark, sf_dir):
    return recipes.pivot_eav(raw_recipes(spark, sf_dir), numeric_max=True)


@query("recipe_label_lists", with_views(["recipes"], """
SELECT recipe_name, unnest(CASE WHEN caution_labels = 'N/A' THEN [] ELSE string_split(caution_labels, '; ') END) AS caution FROM recipes"""))
def recipe_label_lists(spark, sf_dir):
    lists = recipes.label_lists(view(spark, sf_dir, "recipes"))
    return lists.select("recipe_name", F.explode("caution_labels").alias("caution"))


NUMBER_NAMES = ", ".join(f"'{a}'" for a, _ in vocab.NUMBER_ATTRIBUTES)


@query("pivot_rejects", with_views(["raw_recipes"], f"""
SELECT recipe_name, attribute, "value" FROM raw_recipes
WHERE lower(attribute) IN ({NUMBER_NAMES}) AND "value" IS NOT NULL AND TRY_CAST("value" AS DOUBLE) IS NULL"""))
def pivot_rejects(spark, sf_dir):
    return recipes.pivot_rejects(raw_recipes(spark, sf_dir))


@query("incremental_not_in", with_views(["raw_recipes", "known_recipes"], """
SELECT recipe_name, attribute, "value" FROM raw_recipes WHERE recipe_name NOT IN (SELECT recipe_name FROM known_recipes)"""))
def incremental_not_in(spark, sf_dir):
    return recipes.keys_not_in(raw_recipes(spark, sf_dir), view(spark, sf_dir, "known_recipes"), "recipe_name")


@query("incremental_append", with_views(["raw_recipes", "known_recipes"], "WITH fresh AS (SELECT r.* FROM raw_recipes r "
       "ANTI JOIN known_recipes k ON r.recipe_name = k.recipe_name) " + _pivot_sql(False, "fresh")))
def incremental_append(spark, sf_dir):
    return recipes.pivot_new(raw_recipes(spark, sf_dir), view(spark, sf_dir, "known_recipes"))


@query("ledger_new_keys", with_views(["known_recipes"], f"""
SELECT DISTINCT recipe_name FROM (SELECT {EAV_NAME} AS recipe_name FROM part) s ANTI JOIN known_recipes k USING (recipe_name)"""))
def ledger_new_keys(spark, sf_dir):
    keys = load(spark, sf_dir, "part").selectExpr(f"{EAV_NAME} AS recipe_name")
    return recipes.new_keys(keys, view(spark, sf_dir, "known_recipes"), "recipe_name").distinct()


@query("ledger_union", with_views(["known_recipes"], f"""
SELECT recipe_name FROM known_recipes UNION SELECT {EAV_NAME} AS recipe_name FROM part"""))
def ledger_union(spark, sf_dir):
    keys = load(spark, sf_dir, "part").selectExpr(f"{EAV_NAME} AS recipe_name")
    return recipes.ledger_union(view(spark, sf_dir, "known_recipes"), keys)


@query("ledger_sorted", f"SELECT DISTINCT {EAV_NAME} AS recipe_name FROM part ORDER BY 1")
def ledger_sorted(spark, sf_dir):
    return load(spark, sf_dir, "part").selectExpr(f"{EAV_NAME} AS recipe_name").distinct().orderBy("recipe_name")


# Search hits: a recipe turns up under several cuisines, at several places.
HITS = {
    "cuisine_rank": "CAST(l_suppkey % 21 AS INT)",
    "hit_rank": "l_orderkey * 8 + l_linenumber",
    "slug": "'s' || CAST(l_partkey AS STRING)",
}
HITS_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in HITS.items()) + " FROM lineitem"
CAP = vocab.CUISINE_CAP


def _hits(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {a}" for a, e in HITS.items()))


@query("cap_per_group", f"""
WITH u AS (SELECT * FROM ({HITS_SQL}) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY cuisine_rank, hit_rank) = 1)
SELECT cuisine_rank, slug, row_number() OVER (PARTITION BY cuisine_rank ORDER BY hit_rank, slug) AS pick
FROM u QUALIFY pick <= {CAP}""")
def cap_per_group(spark, sf_dir):
    return recipes.cap_first_wins(_hits(spark, sf_dir), CAP).select(
        "cuisine_rank", "slug", F.col("pick").cast("long").alias("pick"))


def _fold_sql() -> str:
    steps = [f"u AS MATERIALIZED (SELECT cuisine_rank, slug, min(hit_rank) AS hit_rank FROM ({HITS_SQL}) GROUP BY ALL)"]
    for i in range(21):
        before = " UNION ALL ".join(f"SELECT slug FROM t{j}" for j in range(i)) or "SELECT NULL AS slug WHERE false"
        steps.append(
            f"t{i} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY hit_rank, slug) AS pick FROM u "
            f"WHERE cuisine_rank = {i} AND slug NOT IN ({before}) QUALIFY pick <= {CAP})")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(
        f"SELECT cuisine_rank, slug, pick FROM t{i}" for i in range(21))


@query("cap_per_group_exact", _fold_sql())
def cap_per_group_exact(spark, sf_dir):
    return recipes.cap_exact(_hits(spark, sf_dir), 21, CAP).select(
        "cuisine_rank", "slug", F.col("pick").cast("long").alias("pick"))


@query("count_per_group", with_views(["recipes"], "SELECT cuisine_type, count(*) AS n FROM recipes GROUP BY cuisine_type"))
def count_per_group(spark, sf_dir):
    return recipes.count_per_group(view(spark, sf_dir, "recipes"), "cuisine_type")


@query("quality_checks", with_views(["raw_recipes"], f"""
WITH w AS ({_pivot_sql(False)})
SELECT 'not_null' AS test, 'recipe_name' AS column_name, count(*) FILTER (WHERE recipe_name IS NULL) AS failures FROM w
UNION ALL SELECT 'not_null', 'servings', count(*) FILTER (WHERE servings IS NULL) FROM w
UNION ALL SELECT 'not_null', 'calories_per_serving_kcal', count(*) FILTER (WHERE calories_per_serving_kcal IS NULL) FROM w
UNION ALL SELECT 'unique', 'recipe_name', (SELECT count(*) FROM (SELECT recipe_name FROM w GROUP BY 1 HAVING count(*) > 1)) """))
def quality_checks(spark, sf_dir):
    return recipes.quality_checks(recipes.pivot_eav(raw_recipes(spark, sf_dir)))


@query("quality_checks_raw", with_views(["raw_recipes"], """
SELECT 'not_null' AS test, 'value' AS column_name, count(*) FILTER (WHERE "value" IS NULL) AS failures FROM raw_recipes
UNION ALL SELECT 'unique', 'recipe_name', (SELECT count(*) FROM (SELECT recipe_name FROM raw_recipes GROUP BY 1 HAVING count(*) > 1))"""))
def quality_checks_raw(spark, sf_dir):
    return recipes.quality_checks(raw_recipes(spark, sf_dir), ["value"], ["recipe_name"])


MIME = f"CASE {P} % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/html' END"


@query("object_key", f"""
SELECT {P}, 'Recipe_EDA/' || {SLUG.format('p_name')} || '/Images/image' || CASE {P} % 4 WHEN 1 THEN '.png' ELSE '.jpg' END AS object_key
FROM part""")
def object_key(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr(P, "p_name", f"{MIME} AS mime")
    return rows.select(P, recipes.image_key(text.slug(F.col("p_name")), F.col("mime")).alias("object_key"))


PATHS = "'RAW_PDFs/' || source || '_' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.tar.PDF' ELSE '' END"


@query("filename_parts", f"""
SELECT path, file, CASE WHEN contains(file, '.') THEN regexp_replace(file, '\\.[^.]*$', '') ELSE file END AS stem,
  split_part(file, '_', 1) AS condition FROM (SELECT {PATHS} AS path, split_part({PATHS}, '/', 2) AS file FROM documents)""")
def filename_parts(spark, sf_dir):
    return documents.name_parts(load(spark, sf_dir, "documents").selectExpr(f"{PATHS} AS path"))


@query("url_strip_query", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def url_strip_query(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.url_without_query(F.col("url")).alias("url"))


# Recipe details with a repeated nutrient and one that is not a target.
DETAILS = f"""named_struct('nutrients', array(
  named_struct('name', 'Calories', 'amount', CAST({P} % 700 AS DOUBLE) + 0.5E0, 'unit', 'kcal'),
  named_struct('name', 'Fat', 'amount', CAST(p_size AS DOUBLE), 'unit', 'g'),
  named_struct('name', 'Caffeine', 'amount', 1.0E0, 'unit', 'mg'),
  named_struct('name', 'Fat', 'amount', CAST(p_size + 1 AS DOUBLE), 'unit', 'g'))) AS nutrition"""


@query("nutrients_map", f"""
SELECT {P}, CAST(CAST({P} % 700 AS DOUBLE) + 0.5E0 AS VARCHAR) || ' kcal' AS calories,
  CAST(CAST(p_size + 1 AS DOUBLE) AS VARCHAR) || ' g' AS fat, CAST(p_size + 1 AS DOUBLE) AS fat_amount,
  CAST(2 AS INTEGER) AS n FROM part""")
def nutrients_map(spark, sf_dir):
    rows = recipes.target_nutrients(load(spark, sf_dir, "part").selectExpr(P, DETAILS))
    fat = F.try_element_at("nutrients", F.lit("Fat"))
    return rows.select(
        P, F.try_element_at("nutrients", F.lit("Calories")).alias("calories"), fat.alias("fat"),
        recipes.amount_of(fat).alias("fat_amount"), F.size("nutrients").alias("n"),
    )


@query("recipe_steps", """
SELECT title, CAST(i - 1 AS INTEGER) AS "position", CAST(i AS INTEGER) AS "number", s AS step FROM (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS title, unnest(string_split(text, chr(10))) AS s,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def recipe_steps(spark, sf_dir):
    block = F.struct(F.transform(
        F.split("text", "\n"), lambda s, i: F.struct((i + 1).alias("number"), s.alias("step"))).alias("steps"))
    rows = load(spark, sf_dir, "documents").select(
        F.expr("'d' || CAST(doc_id AS STRING)").alias("title"),
        # The second block is not looked at.
        F.array(block, block).alias("analyzedInstructions"),
    )
    return recipes.recipe_steps(rows)


@query("recipe_ingredients", """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS title, CAST(generate_subscripts(string_split(text, '. '), 1) - 1 AS INTEGER) AS "position",
  unnest(string_split(text, '. ')) AS ingredient FROM documents""")
def recipe_ingredients(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(
        F.expr("'d' || CAST(doc_id AS STRING)").alias("title"),
        F.transform(F.split("text", r"\. "), lambda s: F.struct(s.alias("original"))).alias("extendedIngredients"),
    )
    return recipes.recipe_ingredients(rows)
