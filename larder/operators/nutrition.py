"""Meal logs: alerts, dashboard tables, running intake.

Logs are reduced to one row per member (or member and day) before they meet the member
table, so a member with very many rows costs no more than the others at the join.
`as_of` is a date string standing in for today.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions import numbers
from larder.operators import scale

KCAL = "calories_per_serving_kcal"


def _day(as_of: str, back: int = 0) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), back)


def since(logs: DataFrame, as_of: str, days: int, until: str | None = None) -> DataFrame:
    """Rows of the last `days` days. Later dates count too unless `until` is given."""
    kept = logs.filter(F.col("date") >= _day(as_of, days - 1))
    return kept if until is None else kept.filter(F.col("date") <= F.lit(until).cast("date"))


def user_week(logs: DataFrame, username: str, as_of: str) -> DataFrame:
    """One member's trailing week in date order."""
    return (
        since(logs, as_of, 7).filter(F.col("username") == username)
        .select("date", "meal_type", "recipe_name", KCAL, "cholesterol_mg", "saturated_g", "trans_g", "fiber_g")
        .orderBy("date")
    )


def daily_summary(users: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Every member's total and meal count of one day, and whether the goal was met."""
    day = logs.filter(F.col("date") == _day(as_of)).groupBy("username").agg(
        F.sum(KCAL).alias("total_kcal"), F.count("recipe_name").alias("meal_count")
    )
    total = F.coalesce("total_kcal", F.lit(0.0))
    return users.join(day, "username", "left").select(
        "username", "email", "tdee", total.alias("total_kcal"),
        F.coalesce("meal_count", F.lit(0)).cast("long").alias("meal_count"),
        (F.abs(total - F.col("tdee")) < 200).alias("goal_met"),
    )


def low_logging(users: DataFrame, logs: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Members without any named meal in the last days."""
    active = since(logs, as_of, days).filter(F.col("recipe_name").isNotNull()).select("username").distinct()
    return users.join(active, "username", "left_anti").select(
        "username", "email", _day(as_of, days - 1).alias("since")
    )


def daily_partials(logs: DataFrame) -> DataFrame:
    """One row per member and day from which the digest of any week is merged: sum, count, greatest and latest recipe."""
    # Of several at one time the last event counts, or without event ids the greatest name.
    last = F.struct("ts", "event_id" if "event_id" in logs.columns else "recipe_name")
    named_at = F.when(F.col("recipe_name").isNotNull(), last)
    return logs.groupBy("username", "date").agg(
        F.sum(KCAL).alias("kcal"), F.count(KCAL).alias("n"), F.max("recipe_name").alias("max_recipe"),
        F.max_by("recipe_name", named_at).alias("last_recipe"), F.max(named_at).alias("ts"),
    )


def _digest(users: DataFrame, days: DataFrame, *keys: str) -> DataFrame:
    """Days merged by `keys` and put beside the members."""
    total = days.groupBy(*keys).agg(
        F.try_divide(F.sum("kcal"), F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("active_days"),
        F.max("max_recipe").alias("max_recipe"), F.max_by("last_recipe", "ts").alias("last_recipe"),
    )
    return users.join(total, list(keys), "left").select(
        *keys[1:], "username", "email", numbers.round_sql(F.col("mean"), 2).alias("avg_kcal"),
        F.coalesce("active_days", F.lit(0)).cast("long").alias("active_days"), "max_recipe", "last_recipe",
    )


def weekly_digest(users: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Mean kcal per logged meal, active days, greatest recipe name and latest recipe.

    The mean runs over meals, not over days; `suggestions` has the mean of daily sums. Days come
    first: the count of them then only sees one row per member and day.
    """
    return _digest(users, daily_partials(since(logs, as_of, 7)), "username")


def weekly_digests(users: DataFrame, partials: DataFrame, first: str, last: str) -> DataFrame:
    """The digest of the week that ends on each day from `first` to `last` (column `as_of`), from stored `daily_partials`.

    The logs are read once, whatever the number of days; a partial goes into the seven weeks that it is part of.
    """
    begin, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    near = partials.filter((F.col("date") >= F.date_sub(begin, 6)) & (F.col("date") <= end))
    weeks = near.withColumn("as_of", F.explode(F.sequence(F.greatest("date", begin), F.least(F.date_add("date", 6), end))))
    everyone = users.withColumn("as_of", F.explode(F.sequence(begin, end)))
    return _digest(everyone, weeks, "username", "as_of")


def critical_low(users: DataFrame, logs: DataFrame, as_of: str, share: float = 0.7) -> DataFrame:
    """Members whose mean meal is below a share of their goal; no logs means no warning."""
    mean = since(logs, as_of, 7).groupBy("username").agg(F.avg(KCAL).alias("mean"))
    return users.join(mean, "username").filter(F.col("mean") < share * F.col("tdee")).select(
        "username", "email", "tdee", numbers.round_sql(F.col("mean"), 2).alias("avg_kcal")
    )


def daily_calories(logs: DataFrame) -> DataFrame:
    """Calorie tracking: one total per member and day."""
    return logs.groupBy("username", "date").agg(F.coalesce(F.sum(KCAL), F.lit(0.0)).alias("total_calories"))


def _goals(users: DataFrame) -> DataFrame:
    return users.select("username", numbers.tdee_or_default(F.col("tdee")).alias("goal"))


def _goal() -> Column:
    return F.coalesce("goal", F.lit(2100)).alias("tdee")


def daily_vs_goal(users: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Daily totals of the trailing week beside the goal, with a chart label."""
    return daily_calories(since(logs, as_of, 7)).join(_goals(users), "username", "left").select(
        "username", "date", F.date_format("date", "EEE\nMMM dd").alias("day"), "total_calories", _goal()
    )


def meal_share(logs: DataFrame, as_of: str) -> DataFrame:
    """Calories per meal type and their share of the member's week."""
    sums = since(logs, as_of, 7).groupBy("username", "meal_type").agg(
        F.coalesce(F.sum(KCAL), F.lit(0.0)).alias("kcal"))
    whole = F.sum("kcal").over(Window.partitionBy("username"))
    return sums.withColumn("percent", F.round(numbers.percent(F.col("kcal"), whole), 1))


def suggestions(users: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Advice from the mean of daily sums and the mean fibre of the trailing week."""
    days = since(logs, as_of, 7).groupBy("username", "date").agg(
        F.coalesce(F.sum(KCAL), F.lit(0.0)).alias("kcal"), F.sum("fiber_g").alias("fiber"),
        F.count("fiber_g").alias("n_fiber"),
    )
    means = days.groupBy("username").agg(
        F.avg("kcal").alias("avg_kcal"), F.try_divide(F.sum("fiber"), F.sum("n_fiber")).alias("avg_fiber")
    )
    notes = F.array_compact(F.array(
        F.when(F.col("avg_kcal") > F.col("tdee"), "over goal: smaller portions")
        .when(F.col("avg_kcal") < 0.8 * F.col("tdee"), "well under goal: eat enough"),
        F.when(F.col("avg_fiber") < 3, "fibre is low: oats, legumes, vegetables"),
    ))
    return (
        means.join(_goals(users), "username", "left")
        .select("username", "avg_kcal", "avg_fiber", _goal())
        .withColumn("notes", notes)
        .withColumn("notes", F.when(F.size("notes") > 0, F.col("notes")).otherwise(F.array(F.lit("on track"))))
    )


def week_days(as_of: str) -> list[str]:
    import datetime as dt

    last = dt.date.fromisoformat(as_of)
    return [(last - dt.timedelta(days=n)).isoformat() for n in range(6, -1, -1)]


def consistency_matrix(logs: DataFrame, as_of: str) -> DataFrame:
    """Meals logged per meal type (rows) and day of the trailing week (columns)."""
    counts = since(logs, as_of, 7, until=as_of).groupBy("username", "meal_type", "date").agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("date") == F.lit(d).cast("date"), F.col("n"))), F.lit(0)).alias(f"d{i}")
        for i, d in enumerate(week_days(as_of))
    ]
    return counts.groupBy("username", "meal_type").agg(*cells)


def nutrient_stack(
    users: DataFrame, logs: DataFrame, as_of: str, condition: str = "cholesterol",
    columns: Sequence[str] = ("cholesterol_mg", "saturated_g", "trans_g"),
) -> DataFrame:
    """Daily nutrient sums of members with a condition, stacked one on another."""
    people = users.filter(F.lower("chronic_condition") == condition).select("username")
    sums = since(logs, as_of, 7).groupBy("username", "date").agg(
        *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns)
    )
    out = sums.join(people, "username", "left_semi")
    bottom: Column = F.lit(0.0)
    for c in columns:
        bottom = bottom + F.col(c)
        out = out.withColumn(f"{c}_top", bottom)
    return out


def plan_picks(picks: DataFrame) -> DataFrame:
    """Meal plan: the first time a member picks a recipe counts, repeats are ignored."""
    return scale.first_per_key(picks, ["username", "recipe_name"], [F.col("ts"), F.col("event_id")])


def remaining_kcal(users: DataFrame, picks: DataFrame) -> DataFrame:
    """Goal minus the running intake of the day, after every pick.

    The running sum goes minute by minute, so a member-day of any size is spread over tasks
    and leaves at most 1440 totals to add up.
    """
    daily = scale.running_sum(
        picks.withColumn("_kcal", F.coalesce(KCAL, F.lit(0.0))), ["username", "date"], ["ts", "event_id"], "_kcal",
        [F.date_trunc("minute", "ts")], "eaten",
    )
    return daily.join(_goals(users), "username", "left").select(
        "username", "date", "event_id", "recipe_name", (_goal_value() - F.col("eaten")).alias("remaining_kcal")
    )


def _goal_value() -> Column:
    return F.coalesce("goal", F.lit(2100))


def log_rows(picks: DataFrame, as_of: str) -> DataFrame:
    """Picked cards as log rows of a day; a missing calorie value is logged as 0."""
    return picks.select(
        "username", F.lit(as_of).cast("date").alias("date"), "meal_type", "recipe_name",
        F.coalesce(F.col("kcal"), F.lit(0.0)).alias(KCAL),
    )


def message_daily(summary: DataFrame, as_of: str) -> DataFrame:
    verdict = F.when(F.col("goal_met"), "goal met").otherwise("off goal today, balance tomorrow")
    return summary.select("username", "email", F.format_string(
        f"Summary for %s on {as_of}: %d meals, %.2f kcal of %s kcal, %s.",
        "username", "meal_count", "total_kcal",
        F.when(F.col("tdee").isNull(), "unknown").otherwise(F.format_string("%.2f", "tdee")), verdict,
    ).alias("message"))


def message_low_logging(alerts: DataFrame) -> DataFrame:
    return alerts.select("username", "email", F.format_string(
        "%s, no meals logged since %s.", "username", F.col("since").cast("string")
    ).alias("message"))


def message_weekly(digest: DataFrame, as_of: str) -> DataFrame:
    return digest.select("username", "email", F.format_string(
        f"Week up to {as_of} for %s: %.2f kcal on average, %d active days, last meal %s.",
        "username", F.coalesce("avg_kcal", F.lit(0.0)), "active_days", F.coalesce("max_recipe", F.lit("None")),
    ).alias("message"))


def message_critical(warnings: DataFrame) -> DataFrame:
    return warnings.select("username", "email", F.format_string(
        "%s, weekly average %.2f kcal is far below the goal of %.2f kcal.", "username", "avg_kcal", "tdee"
    ).alias("message"))
