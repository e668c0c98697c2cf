"""Domain tables derived from the given tables.

The expressions are plain SQL that Spark and the checking engine read alike, with whole
and decimal arithmetic only; the few that differ are given per engine.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import vocab
from larder.operators import scale

AS_OF = "2024-01-30"
# Parts that a task makes tall rows of, about 14 times as many.
PARTS_PER_TASK = 50_000


def _case(expr: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}"
        for i, v in enumerate(values)
    )
    return f"CASE {expr} {arms} END"


def _word(expr: str, words: list[str]) -> str:
    return f"split_part('{','.join(words)}', ',', CAST({expr} AS INT) + 1)"


K = "c_custkey"
USERS = {
    "username": f"'u' || CAST({K} AS STRING)",
    "password": f"'pw' || CAST({K} AS STRING)",
    "first_name": "c_name",
    "last_name": "c_mktsegment",
    "email": f"'u' || CAST({K} AS STRING) || '@example.org'",
    "age": f"CAST(18 + {K} % 60 AS INT)",
    "gender": _case(f"{K} % 3", ["Male", "Female", "Other"]),
    "height": f"CAST(150 + {K} % 50 AS DOUBLE)",
    "weight": f"CAST(50 + {K} % 70 AS DOUBLE)",
    "activity_level": _case(
        f"{K} % 6", ["Sedentary", "Lightly Active", "Moderately Active", "Very Active", "Extra Active", "Unknown"]),
    "chronic_condition": _case(
        f"{K} % 8",
        ["Diabetes", "Cholesterol", "Hypertension", "Chronic Kidney Disease", "Gluten", "Polycystic", " Obesity ", "Asthma"]),
    "location": "CAST(c_nationkey AS STRING)",
    "tdee": f"CASE WHEN {K} % 29 = 0 THEN NULL WHEN {K} % 31 = 0 THEN 0.0E0 ELSE CAST(1200 + ({K} * 37) % 1800 AS DOUBLE) END",
}

LOGS = {
    "event_id": "event_id",
    "username": "'u' || CAST(user_id AS STRING)",
    "ts": "CAST(ts AS TIMESTAMP)",
    "date": "CAST(ts AS DATE)",
    "meal_type": "CASE event_type WHEN 'view' THEN 'Breakfast' WHEN 'click' THEN 'Lunch' WHEN 'purchase' THEN 'Dinner' ELSE 'Snack' END",
    "recipe_name": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'r' || CAST(event_id % 200 AS STRING) END",
    "calories_per_serving_kcal": "CAST(CAST(value AS DECIMAL(12,2)) * 25 AS DOUBLE)",
    "cholesterol_mg": "CASE WHEN event_id % 2 = 0 THEN CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) END",
    "saturated_g": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS DOUBLE) END",
    "trans_g": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS DOUBLE) END",
    "fiber_g": "CASE WHEN event_id % 2 = 0 THEN CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 AS DOUBLE) END",
}

P = "p_partkey"
CUISINE = _word(f"{P} % 21", vocab.CUISINES)
CUISINE_2 = _word(f"({P} + 5) % 21", vocab.CUISINES)
MEAL = _word(f"({P} * 7) % 5", ["breakfast", "lunch/dinner", "dinner", "snack", "brunch"])


def _maybe(expr: str) -> str:
    return f"CASE WHEN {P} % 11 = 0 THEN NULL ELSE CAST({expr} AS DOUBLE) END"


RECIPES = {
    "recipe_name": f"'recipe_' || CAST({P} AS STRING)",
    "cuisine_type": f"CASE WHEN {P} % 4 = 0 THEN {CUISINE} || '; ' || {CUISINE_2} ELSE {CUISINE} END",
    "meal_type": MEAL,
    "dish_type": "lower(p_type)",
    "link": f"'http://example.org/r/' || CAST({P} AS STRING)",
    "image_url": f"'http://example.org/i/' || CAST({P} AS STRING) || '.jpg?size=' || CAST(p_size AS STRING)",
    "ingredients": "p_name",
    "health_labels": "p_brand",
    "diet_labels": "p_type",
    "caution_labels": f"CASE {P} % 6 WHEN 0 THEN 'Gluten; Wheat' WHEN 1 THEN 'Sulfites' WHEN 2 THEN NULL ELSE 'N/A' END",
    "calories_per_serving_kcal": f"CAST(50 + ({P} * 37) % 700 AS DOUBLE)",
    "fat_g": _maybe(f"({P} * 3) % 30"),
    "saturated_g": _maybe(f"({P} * 5) % 12"),
    "trans_g": _maybe(f"{P} % 3"),
    "carbs_g": _maybe(f"({P} * 13) % 80"),
    "fiber_g": _maybe(f"({P} * 11) % 9"),
    "sugars_g": _maybe(f"({P} * 7) % 20"),
    "protein_g": _maybe(f"({P} * 17) % 40"),
    "cholesterol_mg": _maybe(f"({P} * 19) % 120"),
    "sodium_mg": _maybe(f"({P} * 41) % 900"),
    "potassium_mg": _maybe(f"({P} * 29) % 1100"),
    "phosphorus_mg": _maybe(f"({P} * 23) % 500"),
    "servings": f"CAST(1 + {P} % 6 AS DOUBLE)",
}

# Tall recipe attributes: name in file -> value as text. 'Fat' repeats for some recipes.
EAV = [
    ("Cuisine Type", f"CASE WHEN {P} % 5 = 0 THEN NULL ELSE {CUISINE} END"),
    ("MEAL TYPE", MEAL),
    ("Link", f"'http://example.org/r/' || CAST({P} AS STRING)"),
    ("Ingredients", "p_name"),
    ("Health Labels", "p_brand"),
    ("Calories per Serving", f"CAST(50 + ({P} * 37) % 700 AS STRING)"),
    ("Fat", f"CAST(CAST(({P} * 3) % 30 AS DECIMAL(10,1)) AS STRING)"),
    ("fat", f"CASE WHEN {P} % 3 = 0 THEN '9.5' ELSE '10.2' END"),
    ("Saturated", f"CAST(({P} * 5) % 12 AS STRING)"),
    ("Fiber", f"CASE WHEN {P} % 7 = 0 THEN 'n/a' ELSE CAST(({P} * 11) % 9 AS STRING) END"),
    ("Vitamin B12", f"CAST(({P} * 31) % 17 AS STRING)"),
    ("Water", f"CAST(p_size AS STRING)"),
    ("Servings", f"CASE WHEN {P} % 13 = 0 THEN NULL ELSE CAST(1 + {P} % 6 AS STRING) END"),
    ("Unheard of", "p_type"),
]
EAV_NAME = f"'recipe_' || CAST({P} - {P} % 2 AS STRING)"

# Recipes already stored by an earlier load: those returned in the largest quantity; names repeat.
# Names known before: every third part's are recipes, the others are known under another name.
KNOWN = {"recipe_name": "CASE WHEN l_partkey % 3 = 0 THEN 'recipe_' ELSE 'other_' END || CAST(l_partkey AS STRING)"}

DOCS = {
    "doc_id": "doc_id",
    "condition": "source",
    "file_name": "'f' || CAST(doc_id AS STRING)",
    "text": "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END",
}

ARTICLES = {
    "topic": "source",
    "title": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'title ' || CAST(doc_id AS STRING) END",
    "source": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END",
    "url": "'http://example.org/n/' || CAST(doc_id AS STRING)",
    "content": "text",
}

CHUNKS = {
    "chunk_id": "'c' || CAST(vec_id AS STRING)",
    "embedding": "embedding",
    "condition": "'c' || CAST(label AS STRING)",
    "source_file": "'f' || CAST(vec_id % 50 AS STRING)",
    "chunk_index": "CAST(vec_id AS BIGINT)",
    "text": "'text ' || CAST(vec_id AS STRING)",
}

S = "s_suppkey"
TERM = _word(f"({S} * 7) % 11", [t for _, _, t in vocab.FACILITY_TERMS])
FACILITIES = {
    "listing_rank": f"{S}",
    "place_id": f"'p' || CAST({S} - CASE WHEN {S} % 10 = 9 THEN 1 ELSE 0 END AS STRING)",
    "name": f"CASE WHEN {S} % 17 = 0 THEN NULL ELSE s_name || ' ' || {TERM} END",
    "address": f"CASE WHEN {S} % 9 = 0 THEN 'near hospitals' WHEN {S} % 9 = 1 THEN 'healthcare facilities row' WHEN {S} % 9 = 2 THEN NULL ELSE 'Main St' END",
    "rating": f"CASE WHEN {S} % 5 = 0 THEN NULL ELSE CAST({S} % 50 AS DOUBLE) / 10 END",
    "total_ratings": f"CASE WHEN {S} % 6 = 0 THEN NULL ELSE CAST({S} % 300 AS INT) END",
    "latitude": f"CASE WHEN {S} % 23 = 0 THEN NULL ELSE 42.0E0 + CAST(({S} * 37) % 1000 AS DOUBLE) / 2000 END",
    "longitude": f"CASE WHEN {S} % 19 = 0 THEN NULL ELSE -71.5E0 + CAST(({S} * 53) % 1000 AS DOUBLE) / 2000 END",
    "city": "'city' || CAST(s_nationkey % 3 AS STRING)",
    "zipcode": "'1234' || CAST(s_nationkey % 3 AS STRING)",
    "place_type": _case(f"{S} % 4", ["hospital", "doctor", "pharmacy", "health"]),
}

REQUESTS = {
    "request_id": K,
    "query": f"CASE {K} % 3 WHEN 0 THEN 'city' || CAST(c_nationkey % 5 AS STRING) WHEN 1 THEN 'hospital in 12341' ELSE 'help' END",
    "city": f"CASE WHEN {K} % 41 = 0 THEN '' ELSE 'city' || CAST(c_nationkey % 5 AS STRING) END",
    "zipcode": f"CASE WHEN {K} % 43 = 0 THEN NULL WHEN {K} % 47 = 0 THEN '1234' WHEN {K} % 53 = 0 THEN '12345-6789' ELSE '1234' || CAST(c_nationkey % 5 AS STRING) END",
    "facility_type": _case(f"{K} % 6", ["hospital", "clinic", "pharmacy", "mental_health_group", "community_center", "dentist"]),
    "chronic_condition": f"CASE WHEN {K} % 4 = 0 THEN '' ELSE 'Type2' END",
    "latitude": f"CASE WHEN {K} % 37 = 0 THEN NULL ELSE 42.0E0 + CAST(({K} * 17) % 1000 AS DOUBLE) / 2000 END",
    "longitude": f"-71.5E0 + CAST(({K} * 29) % 1000 AS DOUBLE) / 2000",
}

# Option texts of a facility request; Spark builds a map of them, SQL reads the columns.
PARAMS = {
    "emergency_services": f"CASE WHEN {K} % 5 = 0 THEN 'true' END",
    "specialties": f"CASE WHEN {K} % 7 = 0 THEN 'heart, lung' END",
    "hospital_type": f"CASE WHEN {K} % 2 = 0 THEN 'Any' ELSE 'Public' END",
    "clinic_type": f"CASE WHEN {K} % 5 < 2 THEN 'Walk-In' END",
    "telehealth": f"CASE WHEN {K} % 4 = 1 THEN 'true' ELSE 'false' END",
    "wait_time": f"CASE WHEN {K} % 5 = 1 THEN 'Short' END",
    "hours": f"CASE {K} % 5 WHEN 0 THEN 'Open Now' WHEN 1 THEN '24 Hours' WHEN 2 THEN 'Any' END",
    "services": f"CASE WHEN {K} % 7 < 3 THEN 'delivery, vaccines' END",
    "pharmacy_type": f"CASE WHEN {K} % 4 = 2 THEN 'Chain' END",
    "format": f"CASE WHEN {K} % 5 = 3 THEN 'Online' END",
    "facilitation": f"CASE WHEN {K} % 7 = 3 THEN 'Peer-Led' END",
    "meeting_frequency": f"CASE WHEN {K} % 4 = 3 THEN 'Weekly' END",
    "focus": f"CASE WHEN {K} % 3 = 0 THEN 'sleep, stress' END",
}

# Tool steps of a conversation; those of the system are still pending.
STEPS = {
    "conv_id": "conv_id", "turn": "turn", "tool": "role", "tool_input": "'turn ' || CAST(turn AS STRING)",
    "log": "CASE WHEN role = 'system' THEN 'TBD' ELSE text END",
}

TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "users": ("customer", USERS),
    "logs": ("events", LOGS),
    "recipes": ("part", RECIPES),
    "known_recipes": ("lineitem", KNOWN),
    "docs": ("documents", DOCS),
    "chunks": ("embeddings", CHUNKS),
    "facilities": ("supplier", FACILITIES),
    "place_requests": ("customer", REQUESTS),
    "steps": ("conversations", STEPS),
}
FILTERS: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    rows = load(spark, sf_dir, source)
    if name in FILTERS:
        rows = rows.filter(FILTERS[name])
    return rows.selectExpr(*(f"{expr} AS `{alias}`" for alias, expr in columns.items()))


def view_sql(name: str) -> str:
    if name == "articles":
        return articles_sql()
    if name == "raw_recipes":
        return raw_recipes_sql()
    if name == "asked":
        return asked_sql()
    source, columns = TABLES[name]
    where = f" WHERE {FILTERS[name]}" if name in FILTERS else ""
    return "SELECT " + ", ".join(f'{expr} AS "{alias}"' for alias, expr in columns.items()) + f" FROM {source}{where}"


def with_views(names: Iterable[str], body: str, recursive: bool = False) -> str:
    """SQL with the derived tables as common table expressions in front."""
    head = ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.startswith("WITH "):
        return f"{word} {head}, {body[5:]}"
    return f"{word} {head} {body}"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    return rows.selectExpr(
        "CAST(timestampadd(HOUR, -CAST((doc_id * 7) % 400 AS INT), TIMESTAMP '2024-01-31 00:00:00') AS TIMESTAMP) AS published",
        *(f"{expr} AS `{alias}`" for alias, expr in ARTICLES.items()),
    )


def articles_sql() -> str:
    columns = ", ".join(f'{expr} AS "{alias}"' for alias, expr in ARTICLES.items())
    return (
        "SELECT TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST((doc_id * 7) % 400 AS INT)) AS published, "
        f"{columns} FROM documents"
    )


def raw_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall rows of all parts, each of which becomes one row per attribute; so parts are dealt out before that."""
    rows = ", ".join(f"named_struct('attribute', '{a}', 'value', {v})" for a, v in EAV)
    parts = scale.dealt(load(spark, sf_dir, "part"), PARTS_PER_TASK)
    return parts.selectExpr(f"{EAV_NAME} AS recipe_name", f"inline(array({rows}))")


def raw_recipes_sql() -> str:
    rows = ", ".join(f"{{'attribute': '{a}', 'value': {v}}}" for a, v in EAV)
    return (
        f"SELECT recipe_name, r.attribute AS attribute, r.value AS \"value\" FROM "
        f"(SELECT {EAV_NAME} AS recipe_name, unnest([{rows}]) AS r FROM part)"
    )


# Words asked for: cuisines by key, with substrings and an unknown cuisine, and an unknown meal.
ASK_CUISINE = [["Indian", "MEX"], ["italian"], ["an", "Thai"], ["klingon", "French"], ["american"]]
ASK_MEAL = [["Breakfast", "Dinner"], ["lunch"], ["Snack", "Brunch"]]


def _asked_columns() -> tuple[str, str]:
    cuisine = _case(f"{K} % 5", ["|".join(x) for x in ASK_CUISINE])
    meal = _case(f"{K} % 3", ["|".join(x) for x in ASK_MEAL])
    return cuisine, meal


def meal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with word arrays; one market segment asks for no cuisine."""
    cuisine, meal = _asked_columns()
    return load(spark, sf_dir, "customer").select(
        F.expr(f"'u' || CAST({K} AS STRING)").alias("username"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.array().cast("array<string>"))
        .otherwise(F.split(F.expr(cuisine), r"\|")).alias("cuisine_types"),
        F.split(F.expr(meal), r"\|").alias("meal_types"),
    )


def asked_sql() -> str:
    """The same, one row per user, cuisine and meal."""
    cuisine, meal = _asked_columns()
    return (
        "SELECT username, cuisine, unnest(string_split(meals, '|')) AS meal FROM ("
        f"SELECT 'u' || CAST({K} AS STRING) AS username, unnest(CASE WHEN c_mktsegment = 'MACHINERY' THEN [] "
        f"ELSE string_split({cuisine}, '|') END) AS cuisine, {meal} AS meals FROM customer)"
    )


def place_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility requests with their option map."""
    pairs = ", ".join(f"'{n}', {e}" for n, e in PARAMS.items())
    return load(spark, sf_dir, "customer").selectExpr(
        *(f"{expr} AS `{alias}`" for alias, expr in REQUESTS.items()),
        f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS params",
    )


def place_requests_sql() -> str:
    columns = {**REQUESTS, **{f"p_{n}": e for n, e in PARAMS.items()}}
    return "SELECT " + ", ".join(f'{e} AS "{a}"' for a, e in columns.items()) + " FROM customer"
