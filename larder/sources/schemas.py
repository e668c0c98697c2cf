"""Explicit schemas as DDL text; nothing is inferred from data."""

from __future__ import annotations

NUTRIENT = "struct<label:string,quantity:double,unit:string>"
RECIPE = (
    "struct<label:string,url:string,image:string,`yield`:double,calories:double,"
    f"totalNutrients:map<string,{NUTRIENT}>,healthLabels:array<string>,dietLabels:array<string>,"
    "cautions:array<string>,cuisineType:array<string>,mealType:array<string>,dishType:array<string>,"
    "ingredientLines:array<string>>"
)
RECIPE_PAGE = f"hits array<struct<recipe:{RECIPE}>>"

RECIPE_CSV = "attribute string, value string, unit string"
RAW_RECIPES = "recipe_name string, attribute string, value string"

RECIPE_DETAILS = (
    "title string, image string, readyInMinutes int, servings int, "
    "nutrition struct<nutrients:array<struct<name:string,amount:double,unit:string>>>, "
    "extendedIngredients array<struct<original:string>>, "
    "analyzedInstructions array<struct<steps:array<struct<number:int,step:string>>>>"
)
DRUG_LABEL = (
    "label_id bigint, openfda struct<generic_name:array<string>,brand_name:array<string>,"
    "route:array<string>,dosage_form:array<string>>, indications_and_usage array<string>, "
    "adverse_reactions array<string>, dosage_and_administration array<string>"
)
USERS = (
    "id int, username string, password string, first_name string, last_name string, email string, "
    "age int, gender string, height double, weight double, activity_level string, "
    "chronic_condition string, location string, bmi double, bmi_category string, tdee double, "
    "is_active boolean, created_at timestamp, updated_at timestamp"
)
MEAL_LOGS = (
    "username string, date date, meal_type string, recipe_name string, calories_per_serving_kcal double, "
    "cholesterol_mg double, saturated_g double, trans_g double, fiber_g double"
)
CALORIE_TRACKING = "id int, user_id int, date date, total_calories double"
CHUNKS = (
    "chunk_id string, embedding array<float>, condition string, source_file string, "
    "chunk_index bigint, text string"
)
