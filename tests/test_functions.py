"""Column builders on edge values."""

import random

import pytest
from pyspark.sql import functions as F

from larder.functions import geo, numbers, text
from larder.operators import documents, drugs, members, news, recommend


def column(spark, values, build, schema="v double"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(build(F.col("v"))).collect()]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_round_binary_equals_python_round(spark, digits):
    rng = random.Random(3)
    values = [0.125, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, -2.675, 0.0, 1e15, 8.345, 0.285]
    values += [rng.randrange(-10**7, 10**7) / 1000 for _ in range(3000)]
    values += [rng.uniform(-5000, 5000) for _ in range(3000)]
    assert column(spark, values, lambda c: numbers.round_binary(c, digits)) == [float(round(v, digits)) for v in values]


def test_round_sql_is_half_away_from_zero(spark):
    assert column(spark, [2.675, 0.125, -0.125], numbers.round_sql) == [2.68, 0.13, -0.13]


def test_bmi_limits(spark):
    names = column(spark, [18.4999, 18.5, 24.9999, 25.0, 29.9999, 30.0, None], numbers.bmi_category)
    assert names == ["Underweight", "Normal weight", "Normal weight", "Overweight", "Overweight", "Obese", None]


def test_bmi_category_looks_at_the_unrounded_value(spark):
    users = spark.createDataFrame([(100.0, 24.999), (100.0, 18.5), (0.0, 70.0)], "height double, weight double")
    assert [(r.bmi, r.bmi_category) for r in members.with_bmi(users).collect()] == [
        (25.0, "Normal weight"), (18.5, "Normal weight"), (None, None)]


def test_tdee(spark):
    users = spark.createDataFrame(
        [
            (30, "Male", 180.0, 80.0, "Sedentary", "Hypertension"), (30, "Other", 180.0, 80.0, "Sedentary", "Gluten"),
            (30, "MALE", 180.0, 80.0, "Very Active", "Obesity"), (30, "Female", 180.0, 80.0, "None such", "Type2"),
            (30, "Female", 180.0, 80.0, "Extra Active", "CKD"), (30, "Female", 180.0, 80.0, "Extra Active", "Polycystic"),
        ],
        "age int, gender string, height double, weight double, activity_level string, chronic_condition string",
    )
    man, other = 800 + 1125 - 150 + 5, 800 + 1125 - 150 - 161
    assert [r.tdee for r in members.with_tdee(users).collect()] == [
        round(man * 1.2, 2), round(other * 1.2, 2), round(man * 1.725 * 0.85, 2), round(other * 1.2 * 0.90, 2),
        2400.0, round(other * 1.9 * 0.85, 2)]


def test_tdee_default(spark):
    assert column(spark, [None, 0.0, 1999.99], numbers.tdee_or_default) == [2100, 2100, 1999]


def test_blanks_are_those_of_python(spark):
    values = [f"a{chr(c)}b" for c in range(1, 0x3100)]
    assert column(spark, values, text.token_count, "v string") == [len(v.split()) for v in values]
    values = [f"{chr(c)} a {chr(c)}" for c in range(1, 0x3100)]
    assert column(spark, values, text.strip, "v string") == [v.strip() for v in values]


def test_token_count_of_blank_text(spark):
    assert column(spark, ["", "  \n ", "one", " one\ttwo 　three "], text.token_count, "v string") == [0, 0, 1, 3]


def test_slug(spark):
    assert column(spark, ["\t Mac / Cheese ", "A B"], text.slug, "v string") == ["mac___cheese", "a_b"]


def test_zip(spark):
    values = ["12345", "12345-6789", "1234", "123456", "12345-", "1234a", "", None]
    assert column(spark, values, text.zip_is_valid, "v string") == [True, True] + [False] * 6


def test_file_names(spark):
    rows = spark.createDataFrame([("a/b/CKD_Food.pdf",), ("Gluten.tar.PDF",), ("noext_1",), (".hidden",)], "path string")
    assert [(r.file, r.stem, r.condition) for r in documents.name_parts(rows).collect()] == [
        ("CKD_Food.pdf", "CKD_Food", "CKD"), ("Gluten.tar.PDF", "Gluten.tar", "Gluten.tar.PDF"),
        ("noext_1", "noext_1", "noext"), (".hidden", ".hidden", ".hidden")]


def test_preview_lengths(spark):
    rows = spark.createDataFrame(
        [(n, "x" * n) for n in (0, 200, 201, 1200)], "n int, content string"
    ).selectExpr("CAST(NULL AS STRING) title", "CAST(NULL AS STRING) source", "CAST(NULL AS TIMESTAMP) published", "content", "n")
    got = {r.n: r for r in news.preview(rows).collect()}
    assert (got[0].title, got[0].source, got[0].published_text, got[0].preview) == ("Untitled", "Unknown", "N/A", "")
    assert got[200].preview == "x" * 200
    assert got[201].preview == got[1200].preview == "x" * 200 + "..."


def test_drug_defaults_and_combinations(spark):
    names = "struct<generic_name:array<string>,brand_name:array<string>,route:array<string>,dosage_form:array<string>>"
    schema = (f"label_id bigint, openfda {names}, indications_and_usage array<string>, "
              "adverse_reactions array<string>, dosage_and_administration array<string>")
    rows = spark.createDataFrame(
        [
            (1, (["A and B"], None, None, None), None, None, None),
            (2, (["Metformin"], ["X/Y"], None, None), None, None, None),
            (3, (["Metformin", "HCl"], None, ["ORAL"], None), ["i" * 1500, "z"], None, ["d"]),
            (4, (["metformin"], None, None, None), None, None, None),
        ], schema)
    assert [r.label_id for r in drugs.single_ingredient(rows).orderBy("label_id").collect()] == [3, 4]
    card = drugs.find_cards(rows, ["METFORMIN", "unheard"]).collect()
    assert len(card) == 1
    assert card[0].asDict() == {
        "search": "METFORMIN", "label_id": 3, "generic_name": "Metformin, HCl", "brand_name": "N/A", "route": "ORAL",
        "dosage_form": "N/A", "indications": "i" * 1000, "side_effects": "Not specified.", "dosage": "d"}


def test_highlight_first_match_wins(spark):
    rows = spark.createDataFrame(
        [("soluble fiber 3", "Cholesterol"), ("protein and sodium", "CKD"), ("water", "ckd"), ("protein", None)],
        "line string, condition string")
    assert [r[0] for r in rows.select(recommend.highlight(F.col("line"), F.col("condition"))).collect()] == [
        "**🧃 soluble fiber 3**", "**💪 protein and sodium**", "water", "protein"]


def test_haversine(spark):
    row = spark.range(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(row - 111194.93) < 0.1
