"""Alerts and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import jobs
from larder.operators import nutrition, scale
from larder.plans.registry import query
from larder.plans.views import AS_OF, view, with_views

WEEK = f"date >= DATE '{AS_OF}' - 6"
GOAL = "CAST(trunc(coalesce(nullif(u.tdee, 0), 2100)) AS INT)"


def _both(spark, sf_dir):
    return view(spark, sf_dir, "users"), view(spark, sf_dir, "logs")


DAILY = f"""
SELECT u.username, u.email, u.tdee, coalesce(sum(n.calories_per_serving_kcal), 0) AS total_kcal,
  count(n.recipe_name) AS meal_count, abs(coalesce(sum(n.calories_per_serving_kcal), 0) - u.tdee) < 200 AS goal_met
FROM users u LEFT JOIN logs n ON u.username = n.username AND n.date = DATE '{AS_OF}'
GROUP BY u.username, u.email, u.tdee"""
LOW = f"""
SELECT u.username, u.email, DATE '{AS_OF}' - 2 AS since FROM users u
LEFT JOIN logs n ON u.username = n.username AND n.date >= DATE '{AS_OF}' - 2
GROUP BY u.username, u.email HAVING count(n.recipe_name) = 0"""
DIGEST = f"""
SELECT u.username, u.email,
  CAST(round(CAST(avg(n.calories_per_serving_kcal) AS DECIMAL(28,10)), 2) AS DOUBLE) AS avg_kcal,
  count(DISTINCT n.date) AS active_days, max(n.recipe_name) AS max_recipe,
  arg_max(n.recipe_name, (n.ts, n.event_id)) FILTER (WHERE n.recipe_name IS NOT NULL) AS last_recipe
FROM users u LEFT JOIN logs n ON u.username = n.username AND n.{WEEK}
GROUP BY u.username, u.email"""
CRITICAL = f"""
SELECT u.username, u.email, u.tdee,
  CAST(round(CAST(avg(n.calories_per_serving_kcal) AS DECIMAL(28,10)), 2) AS DOUBLE) AS avg_kcal
FROM users u LEFT JOIN logs n ON u.username = n.username AND n.{WEEK}
GROUP BY u.username, u.email, u.tdee HAVING avg(n.calories_per_serving_kcal) < 0.7E0 * u.tdee"""


@query("alert_daily_summary", with_views(["users", "logs"], DAILY))
def alert_daily_summary(spark, sf_dir):
    return nutrition.daily_summary(*_both(spark, sf_dir), AS_OF)


@query("alert_low_logging", with_views(["users", "logs"], LOW))
def alert_low_logging(spark, sf_dir):
    return nutrition.low_logging(*_both(spark, sf_dir), AS_OF)


@query("alert_weekly_digest", with_views(["users", "logs"], DIGEST))
def alert_weekly_digest(spark, sf_dir):
    return nutrition.weekly_digest(*_both(spark, sf_dir), AS_OF)


FIRST_DAY = "2024-01-01"


@query("alert_weekly_digests", with_views(["users", "logs"], f"""
SELECT d.as_of, u.username, u.email,
  CAST(round(CAST(sum(n.calories_per_serving_kcal) / count(n.calories_per_serving_kcal) AS DECIMAL(28,10)), 2) AS DOUBLE) AS avg_kcal,
  count(DISTINCT n.date) AS active_days, max(n.recipe_name) AS max_recipe,
  arg_max(n.recipe_name, (n.ts, n.event_id)) FILTER (WHERE n.recipe_name IS NOT NULL) AS last_recipe
FROM users u CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS as_of) d
LEFT JOIN logs n ON u.username = n.username AND n.date BETWEEN d.as_of - 6 AND d.as_of GROUP BY d.as_of, u.username, u.email"""))
def alert_weekly_digests(spark, sf_dir):
    """The digests of thirty days from partials that are stored once."""
    users, logs = _both(spark, sf_dir)
    partials = scale.settle(nutrition.daily_partials(logs), "day-partials")
    return nutrition.weekly_digests(users, partials, FIRST_DAY, AS_OF)


@query("alert_critical_low", with_views(["users", "logs"], CRITICAL))
def alert_critical_low(spark, sf_dir):
    return nutrition.critical_low(*_both(spark, sf_dir), AS_OF)


@query("alert_messages", with_views(["users", "logs"], f"""
WITH daily AS ({DAILY}), low AS ({LOW}), digest AS ({DIGEST}), critical AS ({CRITICAL})
SELECT 'daily' AS kind, username, email, format('Summary for {{}} on {AS_OF}: {{}} meals, {{:.2f}} kcal of {{}} kcal, {{}}.',
  username, meal_count, total_kcal, coalesce(format('{{:.2f}}', tdee), 'unknown'),
  CASE WHEN goal_met THEN 'goal met' ELSE 'off goal today, balance tomorrow' END) AS message FROM daily
UNION ALL SELECT 'low_logging', username, email, format('{{}}, no meals logged since {{}}.', username, CAST(since AS VARCHAR)) FROM low
UNION ALL SELECT 'weekly', username, email, format('Week up to {AS_OF} for {{}}: {{:.2f}} kcal on average, {{}} active days, last meal {{}}.',
  username, coalesce(avg_kcal, 0.0E0), active_days, coalesce(max_recipe, 'None')) FROM digest
UNION ALL SELECT 'critical', username, email, format('{{}}, weekly average {{:.2f}} kcal is far below the goal of {{:.2f}} kcal.',
  username, avg_kcal, tdee) FROM critical"""))
def alert_messages(spark, sf_dir):
    users, logs = _both(spark, sf_dir)
    parts = jobs.alerts(users, logs, AS_OF)
    tagged = [rows.withColumn("kind", F.lit(kind)) for kind, rows in parts.items()]
    result = tagged[0]
    for rows in tagged[1:]:
        result = result.unionByName(rows)
    return result


@query("filter_trailing_week", with_views(["logs"], f"""
SELECT date, meal_type, recipe_name, calories_per_serving_kcal, cholesterol_mg, saturated_g, trans_g, fiber_g
FROM logs WHERE username = 'u3' AND {WEEK} ORDER BY date"""))
def filter_trailing_week(spark, sf_dir):
    return nutrition.user_week(view(spark, sf_dir, "logs"), "u3", AS_OF)


@query("calorie_tracking", with_views(["logs"], """
SELECT username, date, sum(calories_per_serving_kcal) AS total_calories FROM logs GROUP BY username, date"""))
def calorie_tracking(spark, sf_dir):
    return nutrition.daily_calories(view(spark, sf_dir, "logs"))


@query("dash_daily_vs_tdee", with_views(["users", "logs"], f"""
SELECT n.username, n.date, strftime(n.date, '%a\n%b %d') AS day, sum(calories_per_serving_kcal) AS total_calories,
  coalesce(any_value({GOAL}), 2100) AS tdee
FROM logs n LEFT JOIN users u ON u.username = n.username WHERE n.{WEEK} GROUP BY n.username, n.date"""))
def dash_daily_vs_tdee(spark, sf_dir):
    return nutrition.daily_vs_goal(*_both(spark, sf_dir), AS_OF)


@query("dash_meal_share", with_views(["logs"], f"""
SELECT username, meal_type, sum(calories_per_serving_kcal) AS kcal,
  round(sum(calories_per_serving_kcal) * 100 / sum(sum(calories_per_serving_kcal)) OVER (PARTITION BY username), 1) AS percent
FROM logs WHERE {WEEK} GROUP BY username, meal_type"""))
def dash_meal_share(spark, sf_dir):
    return nutrition.meal_share(view(spark, sf_dir, "logs"), AS_OF)


@query("dash_suggestions", with_views(["users", "logs"], f"""
WITH days AS (SELECT username, date, sum(calories_per_serving_kcal) AS kcal FROM logs WHERE {WEEK} GROUP BY username, date),
fibre AS (SELECT username, avg(fiber_g) AS avg_fiber FROM logs WHERE {WEEK} GROUP BY username),
means AS (SELECT d.username, avg(kcal) AS avg_kcal, any_value(avg_fiber) AS avg_fiber,
  coalesce(any_value({GOAL}), 2100) AS tdee FROM days d JOIN fibre USING (username) LEFT JOIN users u USING (username) GROUP BY d.username)
SELECT username, round(avg_kcal, 4) AS avg_kcal, round(avg_fiber, 4) AS avg_fiber, tdee,
  CASE WHEN avg_kcal > tdee THEN 'over goal: smaller portions' WHEN avg_kcal < 0.8E0 * tdee THEN 'well under goal: eat enough'
    WHEN avg_fiber < 3 THEN '' ELSE 'on track' END
  || CASE WHEN avg_fiber < 3 THEN CASE WHEN avg_kcal > tdee OR avg_kcal < 0.8E0 * tdee THEN ' | ' ELSE '' END
    || 'fibre is low: oats, legumes, vegetables' ELSE '' END AS notes FROM means"""))
def dash_suggestions(spark, sf_dir):
    return nutrition.suggestions(*_both(spark, sf_dir), AS_OF).select(
        "username", F.round("avg_kcal", 4).alias("avg_kcal"), F.round("avg_fiber", 4).alias("avg_fiber"),
        "tdee", F.array_join("notes", " | ").alias("notes"),
    )


CELLS = ", ".join(
    f"count(*) FILTER (WHERE date = DATE '{d}') AS d{i}" for i, d in enumerate(nutrition.week_days(AS_OF)))


@query("dash_consistency_matrix", with_views(["logs"], f"""
SELECT username, meal_type, {CELLS} FROM logs WHERE {WEEK} AND date <= DATE '{AS_OF}' GROUP BY username, meal_type"""))
def dash_consistency_matrix(spark, sf_dir):
    return nutrition.consistency_matrix(view(spark, sf_dir, "logs"), AS_OF)


@query("dash_nutrient_stack", with_views(["users", "logs"], f"""
WITH s AS (SELECT username, date, coalesce(sum(cholesterol_mg), 0) AS cholesterol_mg, coalesce(sum(saturated_g), 0) AS saturated_g,
  coalesce(sum(trans_g), 0) AS trans_g FROM logs
  WHERE {WEEK} AND username IN (SELECT username FROM users WHERE lower(chronic_condition) = 'cholesterol') GROUP BY username, date)
SELECT *, cholesterol_mg AS cholesterol_mg_top, cholesterol_mg + saturated_g AS saturated_g_top,
  cholesterol_mg + saturated_g + trans_g AS trans_g_top FROM s"""))
def dash_nutrient_stack(spark, sf_dir):
    return nutrition.nutrient_stack(*_both(spark, sf_dir), AS_OF)


FIRST = """SELECT * FROM logs WHERE recipe_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY username, recipe_name ORDER BY ts, event_id) = 1"""


def _plan(spark, sf_dir):
    return nutrition.plan_picks(view(spark, sf_dir, "logs").filter(F.col("recipe_name").isNotNull()))


@query("plan_first_pick", with_views(["logs"], f"SELECT username, recipe_name, event_id, date FROM ({FIRST})"))
def plan_first_pick(spark, sf_dir):
    return _plan(spark, sf_dir).select("username", "recipe_name", "event_id", "date")


@query("remaining_kcal", with_views(["users", "logs"], f"""
WITH p AS (SELECT n.username, n.date, n.event_id, n.recipe_name, sum(n.calories_per_serving_kcal) OVER
  (PARTITION BY n.username, n.date ORDER BY n.ts, n.event_id ROWS UNBOUNDED PRECEDING) AS eaten FROM logs n)
SELECT p.username, p.date, p.event_id, p.recipe_name, coalesce({GOAL}, 2100) - p.eaten AS remaining_kcal
FROM p LEFT JOIN users u ON u.username = p.username"""))
def remaining_kcal(spark, sf_dir):
    return nutrition.remaining_kcal(*_both(spark, sf_dir))
