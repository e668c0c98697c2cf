"""Recipe recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import vocab
from larder.operators import nutrition, recommend
from larder.plans.member_queries import SYNONYMS
from larder.plans.registry import query
from larder.plans.views import AS_OF, K, load, meal_requests, view, with_views
from larder.sources import files, scratch

ENERGY = recommend.ENERGY


@query("filter_ilike", with_views(["recipes"], """
SELECT recipe_name FROM recipes WHERE cuisine_type ILIKE '%MEDI_ERR%' AND meal_type ILIKE '%Dinner%'
  AND calories_per_serving_kcal BETWEEN 300 AND 600"""))
def filter_ilike(spark, sf_dir):
    return recommend.matching(
        view(spark, sf_dir, "recipes"), "none", "MEDI_ERR", "Dinner", wildcards=True).select("recipe_name")


@query("filter_not_ilike", with_views(["recipes"], """
SELECT recipe_name, caution_labels FROM recipes WHERE caution_labels NOT ILIKE '%gluten%'"""))
def filter_not_ilike(spark, sf_dir):
    return view(spark, sf_dir, "recipes").filter(recommend.within_limits("Gluten")).select(
        "recipe_name", "caution_labels")


def _limit_sql(condition: str, encourage: bool = False) -> str:
    tests = [f"{c} {op} {b}" for c, op, b in recommend.limits_of(condition, encourage)]
    tests += [f"caution_labels NOT ILIKE '%{w}%'" for c, w in vocab.CONDITION_CAUTIONS if c == condition]
    return " AND ".join(tests) or "true"


def _qualify_sql(encourage: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT recipe_name, '{c}' AS condition FROM recipes WHERE {_limit_sql(c, encourage)}" for c in vocab.CONDITIONS)


@query("filter_thresholds", with_views(["recipes"], f"SELECT recipe_name FROM recipes WHERE {_limit_sql('ckd')}"))
def filter_thresholds(spark, sf_dir):
    return view(spark, sf_dir, "recipes").filter(recommend.within_limits("CKD ")).select("recipe_name")


@query("recommend_qualify", with_views(["recipes"], _qualify_sql()))
def recommend_qualify(spark, sf_dir):
    return recommend.qualify(view(spark, sf_dir, "recipes")).select("recipe_name", "condition")


@query("recommend_qualify_encouraged", with_views(["recipes"], _qualify_sql(True)))
def recommend_qualify_encouraged(spark, sf_dir):
    return recommend.qualify(view(spark, sf_dir, "recipes"), encourage=True).select("recipe_name", "condition")


@query("recommend_qualify_table", with_views(["recipes"], _qualify_sql()))
def recommend_qualify_table(spark, sf_dir):
    return recommend.qualify_by_limits(spark, view(spark, sf_dir, "recipes")).select("recipe_name", "condition")


@query("filter_meal_range", with_views(["recipes"], " UNION ALL ".join(
    f"SELECT recipe_name, '{m}' AS meal FROM recipes WHERE contains(meal_type, '{m}') AND {ENERGY} BETWEEN {lo} AND {hi}"
    for m, lo, hi in vocab.MEAL_RANGES) + " UNION ALL SELECT recipe_name, 'any' FROM recipes"))
def filter_meal_range(spark, sf_dir):
    return view(spark, sf_dir, "recipes").select("recipe_name", F.explode(recommend.recipe_ranges()).alias("meal"))


PROJECT = f"""SELECT recipe_name, image_url, ingredients, link, health_labels, diet_labels, caution_labels, {ENERGY},
  carbs_g, fiber_g, sugars_g FROM recipes WHERE contains(cuisine_type, 'indian') AND contains(meal_type, 'lunch')
  AND {ENERGY} BETWEEN 350 AND 700 AND {_limit_sql('type2')}"""


@query("recommend_project", with_views(["recipes"], PROJECT))
def recommend_project(spark, sf_dir):
    return recommend.matching(view(spark, sf_dir, "recipes"), "Type2", "Indian", "Lunch")


@query("recommend_single", with_views(["recipes"], f"""
SELECT * FROM (SELECT recipe_name, image_url, ingredients, link, health_labels, diet_labels, caution_labels, {ENERGY}
  FROM recipes WHERE contains(cuisine_type, 'an') AND contains(meal_type, 'dinner') AND {ENERGY} BETWEEN 300 AND 600)
ORDER BY recipe_name LIMIT 15"""))
def recommend_single(spark, sf_dir):
    return recommend.first_matching(view(spark, sf_dir, "recipes"), "unheard of", "AN", "dinner")


ARMS = " ".join(f"WHEN '{c}' THEN {_limit_sql(c)}" for c in vocab.CONDITIONS)
RANGES = " ".join(f"WHEN '{m}' THEN {ENERGY} BETWEEN {lo} AND {hi}" for m, lo, hi in vocab.MEAL_RANGES)
KNOWN = ", ".join(f"'{c}'" for c in vocab.CONDITIONS)
PEOPLE = f"""people AS (SELECT username, CASE WHEN s.condition IN ({KNOWN}) THEN s.condition ELSE '' END AS condition
  FROM users LEFT JOIN (VALUES {SYNONYMS}) s(name, condition) ON s.name = lower(trim(chronic_condition))),
req AS (SELECT a.username, p.condition, a.cuisine, a.meal FROM asked a JOIN people p USING (username)),
combos AS (SELECT DISTINCT condition, lower(cuisine) AS c, lower(meal) AS m FROM req),
pool AS (SELECT condition, c, m, recipe_name, {ENERGY}, row_number() OVER (PARTITION BY condition, c, m ORDER BY recipe_name) AS rank
  FROM combos JOIN recipes ON contains(lower(cuisine_type), c) AND contains(lower(meal_type), m)
  AND CASE condition {ARMS} ELSE true END AND CASE m {RANGES} ELSE true END QUALIFY rank <= 5)
"""
BATCH = f"""WITH {PEOPLE} SELECT r.username, r.condition, r.cuisine, r.meal, p.rank, p.recipe_name, p.{ENERGY}
FROM req r {{join}} JOIN pool p ON p.condition = r.condition AND p.c = lower(r.cuisine) AND p.m = lower(r.meal)"""


def _inputs(spark, sf_dir):
    return view(spark, sf_dir, "users"), meal_requests(spark, sf_dir), view(spark, sf_dir, "recipes")


@query("recommend_batch", with_views(["users", "recipes", "asked"], BATCH.format(join="")))
def recommend_batch(spark, sf_dir):
    return recommend.recommend(spark, *_inputs(spark, sf_dir))


@query("recommend_no_match", with_views(["users", "recipes", "asked"], f"""
WITH {PEOPLE} SELECT username, cuisine, meal, 'Nothing in the table fits ' || meal || ' with cuisine ' || cuisine AS message
FROM req r WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.condition = r.condition AND p.c = lower(r.cuisine) AND p.m = lower(r.meal))
UNION ALL SELECT 'u' || CAST({K} AS VARCHAR), NULL, NULL, 'No cuisine or no meal was asked for' FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'guest' || CAST({K} AS VARCHAR), NULL, NULL, 'This member is not registered' FROM customer WHERE {K} % 50 = 0"""))
def recommend_no_match(spark, sf_dir):
    """Wishes without a recipe, requests that name nothing, and requests of guests, who are no members."""
    users, requests, recipes = _inputs(spark, sf_dir)
    found = recommend.unmatched(recommend.recommend(spark, users, requests, recipes, keep_unmatched=True))
    guests = requests.filter("CAST(substr(username, 2) AS BIGINT) % 50 = 0").withColumn(
        "username", F.concat(F.lit("guest"), F.substr("username", F.lit(2))))
    return found.unionByName(recommend.unanswerable(requests.unionByName(guests), users))


@query("recommend_sampled", with_views(["users", "recipes", "asked"], f"""
WITH {PEOPLE.replace('rank <= 5', 'rank <= 15')} SELECT r.username, r.condition, r.cuisine, r.meal, p.recipe_name, p.{ENERGY},
  row_number() OVER (PARTITION BY r.username, r.cuisine, r.meal
    ORDER BY substr(md5('7|' || r.username || '|' || p.recipe_name), 1, 16), p.rank) AS rank
FROM req r JOIN pool p ON p.condition = r.condition AND p.c = lower(r.cuisine) AND p.m = lower(r.meal) QUALIFY row_number() OVER
  (PARTITION BY r.username, r.cuisine, r.meal ORDER BY substr(md5('7|' || r.username || '|' || p.recipe_name), 1, 16), p.rank) <= 5"""))
def recommend_sampled(spark, sf_dir):
    return recommend.recommend(spark, *_inputs(spark, sf_dir), seed=7)


@query("sample_k_per_group", with_views(["recipes"], """
SELECT cuisine_type, recipe_name FROM recipes QUALIFY row_number() OVER
  (PARTITION BY cuisine_type ORDER BY substr(md5('7|' || recipe_name), 1, 16), recipe_name) <= 5"""))
def sample_k_per_group(spark, sf_dir):
    rows = view(spark, sf_dir, "recipes").select("cuisine_type", "recipe_name")
    return recommend.sample_per_group(rows, ["cuisine_type"], "recipe_name", 5, 7)


def _nutrient_sql(condition: str) -> str:
    columns = recommend.select_for(condition)[len(recommend.BASE_COLUMNS) + 1:]
    if not columns:
        return "''"
    titles = {c: " ".join(w.capitalize() for w in c.split("_")) for c in columns}
    return " || ".join(
        f"chr(10) || '{vocab.SYMBOL_DEFAULT} {titles[c]}: ' || coalesce(CAST({c} AS VARCHAR), 'N/A')" for c in columns)


CARD_ARMS = " ".join(f"WHEN '{c}' THEN {_nutrient_sql(c)}" for c in vocab.CONDITIONS)
CARD = f"""concat_ws('  ' || chr(10), '🍽️ **' || recipe_name || '**', '🔗 [View Recipe](' || link || ')',
  '📸 ImageURL: ' || split_part(image_url, '?', 1), '📝 Ingredients: ' || ingredients, '💡 Health Labels: ' || health_labels,
  '⚠️ Caution Tags: ' || caution_labels, '🔥 Calories/Serving: ' || CAST({ENERGY} AS VARCHAR) || ' kcal')
  || CASE condition {CARD_ARMS} ELSE '' END || chr(10)"""


@query("render_recipe_cards", with_views(["users", "recipes", "asked"], f"""
WITH {PEOPLE}, picked AS (SELECT r.username, r.condition, r.cuisine, r.meal, p.rank, p.recipe_name
  FROM req r JOIN pool p ON p.condition = r.condition AND p.c = lower(r.cuisine) AND p.m = lower(r.meal))
SELECT username, condition, cuisine, meal, rank, recipe_name, {CARD} AS card FROM picked JOIN recipes USING (recipe_name)"""))
def render_recipe_cards(spark, sf_dir):
    users, requests, table = _inputs(spark, sf_dir)
    return recommend.cards(recommend.recommend(spark, users, requests, table), table)


@query("render_recipe_blocks", with_views(["users", "recipes", "asked"], f"""
WITH {PEOPLE}, picked AS (SELECT r.username, r.condition, r.cuisine, r.meal, p.rank, p.recipe_name
  FROM req r JOIN pool p ON p.condition = r.condition AND p.c = lower(r.cuisine) AND p.m = lower(r.meal))
SELECT username, cuisine, meal, '### 🥗 ' || meal || ' (' || cuisine || ')' || chr(10) || chr(10) || string_agg({CARD}, chr(10) ORDER BY rank) AS block
FROM picked JOIN recipes USING (recipe_name) GROUP BY username, cuisine, meal"""))
def render_recipe_blocks(spark, sf_dir):
    users, requests, table = _inputs(spark, sf_dir)
    return recommend.card_blocks(recommend.cards(recommend.recommend(spark, users, requests, table), table))


# Rendered results per part: a heading, then two cards, one of them without bold name or with bad calories.
RENDERED = """'### Lunch (' || p_type || ')' || chr(10) || chr(10) || '🍽️ **' || p_name || '**  ' || chr(10) || '📸 ImageURL: x'
  || chr(10) || '📝 Ingredients: ' || p_brand || chr(10) || '🔥 Calories/Serving: ' || CAST(p_size AS STRING) || '.5 kcal'
  || chr(10) || '🧬 Sodium Mg: 4' || chr(10) || chr(10) || '🍽️ plain ' || p_name || chr(10) || '🔥 Calories/Serving: none kcal' || chr(10)"""


def _rendered(spark, sf_dir):
    return recommend.parse_cards(load(spark, sf_dir, "part").selectExpr("p_partkey", f"{RENDERED} AS result"))


PARSED = """SELECT p_partkey, 1 AS "position", p_name AS recipe_name, CAST(p_size AS DOUBLE) + 0.5E0 AS kcal,
  '📝 Ingredients: ' || p_brand || '|🧬 Sodium Mg: 4' AS lines, 'Breakfast' AS meal_type FROM part
UNION ALL SELECT p_partkey, 2, 'plain ' || p_name, NULL, '', 'Breakfast' FROM part"""


@query("parse_recipe_blocks", PARSED)
def parse_recipe_blocks(spark, sf_dir):
    return _rendered(spark, sf_dir).withColumn("lines", F.array_join("lines", "|"))


@query("sink_append_log", f"""
SELECT 'u' || CAST(p_partkey AS VARCHAR) AS username, DATE '{AS_OF}' AS date, meal_type, recipe_name,
  coalesce(kcal, 0) AS {ENERGY} FROM ({PARSED})""")
def sink_append_log(spark, sf_dir):
    """The picks of even and of odd parts, appended one after the other to a log that is then read."""
    picks = _rendered(spark, sf_dir).withColumn("username", F.expr("'u' || CAST(p_partkey AS STRING)"))
    log = scratch.new_dir(spark, "meal-log")
    for odd in (0, 1):
        files.append_rows(nutrition.log_rows(picks.filter(F.col("p_partkey") % 2 == odd), AS_OF), log, "date")
    return spark.read.parquet(log).withColumn("date", F.col("date").cast("date"))


def _highlight_sql() -> str:
    arms = []
    for condition, words in vocab.HIGHLIGHTS.items():
        tests = " ".join(
            f"WHEN contains(lower(line), '{w.lower()}') THEN '**{vocab.SYMBOLS.get(w, vocab.SYMBOL_DEFAULT)} ' || line || '**'"
            for w in words)
        arms.append(f"WHEN '{condition}' THEN CASE {tests} ELSE line END")
    return f"CASE lower(condition) {' '.join(arms)} ELSE line END"


LINE = """CASE p_partkey % 5 WHEN 0 THEN 'Sodium Mg: ' WHEN 1 THEN 'carbohydrates G: ' WHEN 2 THEN 'Added Sugars and Fiber '
  WHEN 3 THEN 'Saturated Fat, Cholesterol ' ELSE 'Water ' END || CAST(p_size AS STRING)"""
LINE_CONDITION = "split_part('CKD,Cholesterol,type2,obesity,Hypertension,Polycystic,gluten', ',', CAST(p_partkey % 7 AS INT) + 1)"


@query("highlight_lines", f"""
SELECT p_partkey, {_highlight_sql()} AS shown FROM (SELECT p_partkey, {LINE} AS line, {LINE_CONDITION} AS condition FROM part)""")
def highlight_lines(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey", f"{LINE} AS line", f"{LINE_CONDITION} AS condition")
    return rows.select("p_partkey", recommend.highlight(F.col("line"), F.col("condition")).alias("shown"))


@query("bucket_by_position", """
SELECT l_orderkey, l_linenumber, CASE WHEN i < 6 THEN 'Breakfast' WHEN i < 11 THEN 'Lunch' WHEN i < 16 THEN 'Dinner' ELSE 'Snack' END AS meal
FROM (SELECT *, (l_partkey % 20) AS i FROM lineitem)""")
def bucket_by_position(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", recommend.meal_of_position(F.col("l_partkey") % 20).alias("meal"))
