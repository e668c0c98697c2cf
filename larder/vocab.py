"""Word lists, limits and lookup tables the results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Cuisines in collection order.
CUISINES = [
    "indian", "mediterranean", "mexican", "italian", "american", "chinese", "french",
    "thai", "japanese", "greek", "spanish", "korean", "vietnamese", "lebanese",
    "turkish", "moroccan", "german", "british", "cuban", "brazilian", "ethiopian",
]
CUISINE_CAP = 560
DAILY_KCAL = 2000.0

# Recipe attribute -> text column.
TEXT_ATTRIBUTES = [
    ("cuisine type", "cuisine_type"),
    ("meal type", "meal_type"),
    ("dish type", "dish_type"),
    ("link", "link"),
    ("image url", "image_url"),
    ("ingredients", "ingredients"),
    ("health labels", "health_labels"),
    ("diet labels", "diet_labels"),
    ("cautionary tags", "caution_labels"),
]

# Recipe attribute -> numeric column.
NUMBER_ATTRIBUTES = [
    ("calories per serving", "calories_per_serving_kcal"),
    ("fat", "fat_g"),
    ("saturated", "saturated_g"),
    ("trans", "trans_g"),
    ("monounsaturated", "monounsaturated_g"),
    ("polyunsaturated", "polyunsaturated_g"),
    ("carbs", "carbs_g"),
    ("carbohydrates (net)", "net_carbs_g"),
    ("fiber", "fiber_g"),
    ("sugars", "sugars_g"),
    ("protein", "protein_g"),
    ("cholesterol", "cholesterol_mg"),
    ("sodium", "sodium_mg"),
    ("calcium", "calcium_mg"),
    ("magnesium", "magnesium_mg"),
    ("potassium", "potassium_mg"),
    ("iron", "iron_mg"),
    ("zinc", "zinc_mg"),
    ("phosphorus", "phosphorus_mg"),
    ("vitamin a", "vitamin_a_mcg"),
    ("vitamin c", "vitamin_c_mg"),
    ("thiamin (b1)", "thiamin_b1_mg"),
    ("riboflavin (b2)", "riboflavin_b2_mg"),
    ("niacin (b3)", "niacin_b3_mg"),
    ("vitamin b6", "vitamin_b6_mg"),
    ("vitamin b12", "vitamin_b12_mcg"),
    ("vitamin d", "vitamin_d_mcg"),
    ("vitamin e", "vitamin_e_mg"),
    ("vitamin k", "vitamin_k_mcg"),
    ("folate equivalent (total)", "folate_equivalent_total_mcg"),
    ("folate (food)", "folate_food_mcg"),
    ("folic acid", "folic_acid_mcg"),
    ("water", "water_g"),
    ("daily value %", "daily_value_pct"),
    ("servings", "servings"),
]

# Label arrays of a nested recipe -> attribute name.
LABEL_FIELDS = [
    ("healthLabels", "Health Labels"),
    ("dietLabels", "Diet Labels"),
    ("cautions", "Cautionary Tags"),
    ("cuisineType", "Cuisine Type"),
    ("mealType", "Meal Type"),
    ("dishType", "Dish Type"),
    ("ingredientLines", "Ingredients"),
]
ENERGY_KEY = "ENERC_KCAL"

# Condition -> (recipe column, direction, limit).
CONDITION_LIMITS = [
    ("cholesterol", "cholesterol_mg", "<=", 60.0),
    ("cholesterol", "saturated_g", "<=", 6.0),
    ("cholesterol", "trans_g", "<=", 1.0),
    ("cholesterol", "fiber_g", "<=", 3.0),
    ("type2", "sugars_g", "<=", 8.0),
    ("type2", "carbohydrates_g", "<=", 35.0),
    ("type2", "fiber_g", "<=", 5.0),
    ("hypertension", "sodium_mg", "<=", 500.0),
    ("hypertension", "potassium_mg", "<=", 700.0),
    ("obesity", "calories_per_serving_kcal", "<=", 500.0),
    ("obesity", "fat_g", "<=", 17.0),
    ("obesity", "sugars_g", "<=", 10.0),
    ("ckd", "protein_g", "<=", 15.0),
    ("ckd", "sodium_mg", "<=", 500.0),
    ("ckd", "phosphorus_mg", "<=", 300.0),
    ("ckd", "potassium_mg", "<=", 400.0),
    ("polycystic", "sugars_g", "<=", 10.0),
    ("polycystic", "carbohydrates_g", "<=", 30.0),
    ("polycystic", "fiber_g", "<=", 5.0),
]
# Limits that name a nutrient by another word than the recipe table does.
LIMIT_ALIASES = {"carbohydrates_g": "carbs_g"}
# Limits whose nutrient is meant to be encouraged; used by the opt-in direction.
ENCOURAGED = {
    ("cholesterol", "fiber_g"),
    ("type2", "fiber_g"),
    ("polycystic", "fiber_g"),
    ("hypertension", "potassium_mg"),
}
# Conditions that exclude recipes whose caution labels mention a word.
CONDITION_CAUTIONS = [("gluten", "gluten")]
CONDITIONS = ["cholesterol", "type2", "hypertension", "obesity", "ckd", "gluten", "polycystic"]

# Display names -> condition.
CONDITION_SYNONYMS = [
    ("diabetes", "type2"),
    ("type2", "type2"),
    ("cholesterol", "cholesterol"),
    ("hypertension", "hypertension"),
    ("chronic kidney disease", "ckd"),
    ("ckd", "ckd"),
    ("gluten intolerance", "gluten"),
    ("gluten", "gluten"),
    ("polycystic", "polycystic"),
    ("obesity", "obesity"),
]

# Meal -> kcal range per serving.
MEAL_RANGES = [
    ("breakfast", 200.0, 300.0),
    ("lunch", 350.0, 700.0),
    ("dinner", 300.0, 600.0),
    ("snack", 50.0, 300.0),
]

ACTIVITY_FACTORS = [
    ("Sedentary", 1.2),
    ("Lightly Active", 1.375),
    ("Moderately Active", 1.55),
    ("Very Active", 1.725),
    ("Extra Active", 1.9),
]
ACTIVITY_DEFAULT = 1.2
TDEE_SHARE = [("obesity", 0.85), ("type2", 0.90), ("polycystic", 0.85)]
CKD_KCAL_PER_KG = 30.0
TDEE_DEFAULT = 2100.0
BMI_LIMITS = [(18.5, "Underweight"), (25.0, "Normal weight"), (30.0, "Overweight")]
BMI_TOP = "Obese"

# Facility type -> search terms in the order they are tried.
FACILITY_TERMS = [
    ("hospital", 1, "hospitals"),
    ("hospital", 2, "medical centers"),
    ("clinic", 1, "medical clinics"),
    ("clinic", 2, "healthcare clinics"),
    ("pharmacy", 1, "pharmacies"),
    ("pharmacy", 2, "drugstores"),
    ("mental_health_group", 1, "mental health support groups"),
    ("mental_health_group", 2, "mental health peer support"),
    ("mental_health_group", 3, "depression support groups"),
    ("mental_health_group", 4, "anxiety support groups"),
    ("mental_health_group", 5, "mental health community centers"),
]
FACILITY_TERM_DEFAULT = "healthcare facilities"
# Facility type -> place type used by the radius search.
PLACE_TYPES = [
    ("hospital", "hospital"),
    ("clinic", "doctor"),
    ("pharmacy", "pharmacy"),
    ("mental_health_group", "health"),
]
PLACE_TYPE_DEFAULT = "hospital"
CONDITION_FREE_TYPES = ["pharmacy", "mental_health_group"]
TYPE_ALIASES = {"community_center": "mental_health_group"}
MAPS_LINK = "https://www.google.com/maps/place/?q=place_id:"
MAP_CENTRE = (42.3601, -71.0589)

# Texts of refused and answered facility searches.
CITY_MISSING = "A city has to be named"
ZIP_MISSING = "A zip code has to be given"
ZIP_INVALID = "Zipcode is not valid"
FACILITIES_FOUND = "%s places of care near %s"
FACILITIES_NONE = "No place of care near %s"

# Text for a wish without recipes: meal, cuisine.
NO_RECIPES = "Nothing in the table fits %s with cuisine %s"
# Texts for requests that cannot be answered.
UNKNOWN_MEMBER = "This member is not registered"
NOTHING_ASKED = "No cuisine or no meal was asked for"
# Heading above the cards of a wish: meal, cuisine.
CARD_HEADING = "### 🥗 %s (%s)\n\n"

# Condition -> nutrient words whose lines are highlighted, first match wins.
HIGHLIGHTS = {
    "ckd": ["Protein", "Sodium", "Phosphorus", "Potassium"],
    "cholesterol": ["Cholesterol", "Saturated Fat", "Soluble Fiber"],
    "type2": ["Added Sugars", "Carbohydrates", "Fiber"],
    "obesity": ["Calories", "Fat", "Added Sugars"],
    "hypertension": ["Sodium", "Potassium"],
    "polycystic": ["Added Sugars", "Carbohydrates", "Fiber", "Omega 3"],
}
SYMBOLS = {
    "Protein": "💪", "Sodium": "🧂", "Phosphorus": "🧪", "Potassium": "🍌",
    "Carbohydrates": "🍞", "Fiber": "🌾", "Fat": "🥑", "Sugars": "🍭",
    "Cholesterol": "❤️", "Calories": "🔥", "Added Sugars": "🚫🍬",
    "Saturated Fat": "🥩", "Soluble Fiber": "🧃", "Omega 3": "🐟",
}
SYMBOL_DEFAULT = "🧬"

# Nutrients kept from a nested nutrient list.
TARGET_NUTRIENTS = [
    "Calories", "Carbohydrates", "Protein", "Fat", "Sugar", "Fiber",
    "Sodium", "Cholesterol", "Saturated Fat",
]

SUMMARY_QUESTIONS = [
    (1, "What kind of condition is this?"),
    (2, "Which symptoms does it cause?"),
    (3, "Which stages does it go through?"),
    (4, "How is it treated?"),
    (5, "Which habits or home remedies help?"),
    (6, "Which medicines are used?"),
    (7, "What do doctors advise in general?"),
]

MIME_EXTENSIONS = [
    ("image/jpeg", ".jpg"),
    ("image/png", ".png"),
    ("image/gif", ".gif"),
    ("image/webp", ".webp"),
]
MIME_DEFAULT = ".jpg"


def condition_limits(spark: SparkSession, encourage: bool = False) -> DataFrame:
    """Limit table; `encourage` turns the limits of encouraged nutrients into minima."""
    rows = [
        (c, LIMIT_ALIASES.get(col, col), ">=" if encourage and (c, col) in ENCOURAGED else op, limit)
        for c, col, op, limit in CONDITION_LIMITS
    ]
    return spark.createDataFrame(rows, "condition string, nutrient string, op string, bound double")


def condition_synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITION_SYNONYMS, "name string, condition string")
