"""Rounding and body-metric column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder import vocab

_SPLITTER = float(2**27 + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    scaled = x * F.lit(_SPLITTER)
    high = scaled - (scaled - x)
    return high, x - high


def round_binary(col: Column, digits: int = 0) -> Column:
    """Round a double by its exact binary value, ties to even.

    `round` and `bround` round the shortest decimal that prints the double, so they turn
    2.675 (stored just below) into 2.68. Here the rounding error of `x * 10**digits` is
    recovered by an error-free product and decides the apparent ties. From 2**52 units on, where
    doubles lie at least a unit apart, the value is rounded as a decimal.
    """
    x = col.cast("double")
    if digits == 0:
        return F.rint(x)
    power = float(10**digits)
    product = x * F.lit(power)
    xh, xl = _halves(x)
    ph, pl = _halves(F.lit(power))
    error = ((xh * ph - product) + xh * pl + xl * ph) + xl * pl
    floor = F.floor(product).cast("double")
    fraction = product - floor
    units = (
        F.when(fraction != 0.5, F.rint(product))
        .when(error > 0, floor + 1.0)
        .when(error < 0, floor)
        .otherwise(F.rint(product))
    )
    large = F.coalesce(F.bround(x.try_cast("decimal(38,10)"), digits).cast("double"), x)
    return F.when(F.abs(product) < float(2**52), units / F.lit(power)).otherwise(large)


def round_sql(col: Column, digits: int = 2) -> Column:
    """Round half away from zero on a decimal, as `round(x::numeric, n)` does."""
    return F.round(col.cast("decimal(28,10)"), digits).cast("double")


def bmi(height_cm: Column, weight_kg: Column) -> Column:
    """Unrounded body-mass index; a zero height gives NULL."""
    metres = height_cm / F.lit(100.0)
    return F.try_divide(weight_kg.cast("double"), metres * metres)


def bmi_category(value: Column) -> Column:
    chain = F.when(value < vocab.BMI_LIMITS[0][0], vocab.BMI_LIMITS[0][1])
    for limit, name in vocab.BMI_LIMITS[1:]:
        chain = chain.when(value < limit, name)
    return F.when(value.isNotNull(), chain.otherwise(vocab.BMI_TOP))


def activity_factor(level: Column) -> Column:
    pairs = [F.lit(part) for pair in vocab.ACTIVITY_FACTORS for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(vocab.ACTIVITY_DEFAULT))


def tdee(
    age: Column, gender: Column, height_cm: Column, weight_kg: Column, level: Column, condition: Column
) -> Column:
    """Daily energy need: Mifflin-St Jeor, activity factor, condition adjustment."""
    offset = F.when(F.lower(gender) == "male", 5.0).otherwise(-161.0)
    base = 10.0 * weight_kg + 6.25 * height_cm - 5.0 * age + offset
    total = base * activity_factor(level)
    key = F.lower(condition)
    adjusted = F.when(key == "ckd", F.lit(vocab.CKD_KCAL_PER_KG) * weight_kg)
    for name, share in vocab.TDEE_SHARE:
        adjusted = adjusted.when(key == name, total * share)
    return round_binary(adjusted.otherwise(total), 2)


def tdee_or_default(col: Column) -> Column:
    """Whole-number daily goal; missing or zero reads as the default."""
    return F.coalesce(F.nullif(col, F.lit(0.0)), F.lit(vocab.TDEE_DEFAULT)).cast("int")


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)
