"""Recipe ingestion on literal rows."""

import json
import random

from pyspark.sql import functions as F

from larder.operators import recipes
from larder.sources import files, schemas


def recipe(label, **more):
    return {"recipe": {"label": label, "url": "u", "image": "i", "yield": 4, "calories": 1001.0, **more}}


PAGE = {"hits": [
    recipe(" Mac / Cheese", totalNutrients={
        "ENERC_KCAL": {"label": "Energy", "quantity": 9, "unit": "kcal"},
        "FAT": {"label": "Fat", "quantity": 10.7, "unit": "g"},
    }, healthLabels=["A", "B"], dietLabels=[], cuisineType=["american"]),
    recipe("zero", **{"yield": 0}),
    {"recipe": {"label": "bare"}},
]}


def test_json_to_tall_rows(spark, tmp_path):
    (tmp_path / "page1.json").write_text(json.dumps(PAGE, indent=1))
    rows = recipes.explode_hits(files.read_recipe_json(spark, str(tmp_path)))
    assert rows.count() == 3
    assert [r.label for r in recipes.recipe_rejects(rows).collect()] == ["zero"]
    tall = recipes.unpivot_nutrients(rows).orderBy("recipe_name", "position").collect()
    assert [tuple(r)[2:] for r in tall if r.recipe_name == "mac___cheese"] == [
        ("Fat", "2.67", "g"),  # 2.675 is stored just below and rounds down
        ("Servings", "4.0", "-"), ("Calories per Serving", "250", "kcal"), ("Daily Value %", "12.5", "%"),
        ("Health Labels", "A; B", "-"), ("Cuisine Type", "american", "-"), ("Link", "u", "-"), ("Image URL", "i", "-")]
    assert [tuple(r)[2:] for r in tall if r.recipe_name == "bare"] == [
        ("Servings", "1.0", "-"), ("Calories per Serving", "0", "kcal"), ("Daily Value %", "0.0", "%"),
        ("Link", "", "-"), ("Image URL", "", "-")]


def test_csv_key_from_file_name_and_bad_rows(spark, tmp_path):
    folder = tmp_path / "Recipe_EDA" / "mac_cheese"
    folder.mkdir(parents=True)
    (folder / "mac_cheese.csv").write_text(
        'Nutrient,Amount per Serving,Unit\nFat,2.5,g\nbroken,1,g,extra,cells\n"Cuisine Type","a, b",-\n')
    (folder / "notes.txt").write_text("Nutrient,x\n")
    rows = files.read_recipe_csvs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("mac_cheese", "Cuisine Type", "a, b"), ("mac_cheese", "Fat", "2.5")]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "page1.json").write_text(json.dumps(PAGE))
    tall = recipes.unpivot_nutrients(recipes.explode_hits(files.read_recipe_json(spark, str(tmp_path / "page1.json"))))
    files.write_recipe_csvs(tall, str(tmp_path / "out"))
    assert (tmp_path / "out" / "recipe_name=mac___cheese").is_dir()
    back = files.read_recipe_partitions(spark, str(tmp_path / "out"))
    expected = tall.select("recipe_name", "attribute", F.nullif("value", F.lit("")).alias("value"))
    assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_RECIPES)


def test_pivot_takes_the_string_maximum(spark):
    rows = raw(spark, [("r", "FAT", "9.5"), ("r", "fat", "10.2"), ("r", "Sodium", "much"), (None, "fat", "1")])
    got = {r.recipe_name: r for r in recipes.pivot_eav(rows).collect()}
    assert (got["r"].fat_g, got["r"].sodium_mg, got["r"].cuisine_type) == (9.5, None, "N/A")
    assert got[None].fat_g == 1.0
    assert recipes.pivot_eav(rows, numeric_max=True).filter("recipe_name = 'r'").first().fat_g == 10.2
    assert [tuple(r) for r in recipes.pivot_rejects(rows).collect()] == [("r", "Sodium", "much")]


def test_not_in_null_rules(spark):
    rows = raw(spark, [("a", "x", "1"), ("b", "x", "1"), (None, "x", "1")])
    names = lambda known: sorted(
        str(r.recipe_name) for r in recipes.keys_not_in(rows, raw(spark, [(k, "", "") for k in known]), "recipe_name").collect())
    assert names(["a"]) == ["b"]
    assert names(["a", None]) == []
    assert names([]) == ["None", "a", "b"]
    known = raw(spark, [("a", "", ""), (None, "", "")])
    assert sorted(str(r.recipe_name) for r in recipes.new_keys(rows, known, "recipe_name").collect()) == ["None", "b"]


def test_cap_exact_equals_a_walk(spark):
    rng = random.Random(11)
    hits = [(rng.randrange(6), i, f"s{rng.randrange(60)}") for i in range(600)]
    frame = spark.createDataFrame(hits, "cuisine_rank int, hit_rank int, slug string")
    for cap in (1, 4, 9, 100):
        taken, expected = set(), []
        for cuisine in range(6):
            count = 0
            for c, _, slug in sorted(hits):
                if c == cuisine and slug not in taken and count < cap:
                    taken.add(slug)
                    count += 1
                    expected.append((cuisine, slug, count))
        got = recipes.cap_exact(frame, 6, cap).select("cuisine_rank", "slug", "pick").collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_cap_first_wins_gives_a_slug_to_its_first_cuisine(spark):
    hits = [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c"), (0, 3, "a")]
    frame = spark.createDataFrame(hits, "cuisine_rank int, hit_rank int, slug string")
    got = recipes.cap_first_wins(frame, 1).select("cuisine_rank", "slug").collect()
    assert sorted(map(tuple, got)) == [(0, "a"), (1, "c")]
    got = recipes.cap_exact(frame, 2, 1).select("cuisine_rank", "slug").collect()
    assert sorted(map(tuple, got)) == [(0, "a"), (1, "b")]


def test_quality_checks(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", None, 2.0), (None, 1.0, None), (None, 1.0, 1.0)],
        "recipe_name string, servings double, calories_per_serving_kcal double")
    assert sorted(map(tuple, recipes.quality_checks(rows).collect())) == [
        ("not_null", "calories_per_serving_kcal", 1), ("not_null", "recipe_name", 2), ("not_null", "servings", 1),
        ("unique", "recipe_name", 1)]


def test_append_new_is_incremental(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = recipes.pivot_eav(raw(spark, [("a", "fat", "1"), ("b", "fat", "2")]))
    more = recipes.pivot_eav(raw(spark, [("b", "fat", "7"), ("c", "fat", "3")]))
    for batch in (rows, rows, more, more):
        recipes.append_new(spark, batch, path, "recipe_name")
    read = lambda: {r.recipe_name: r.fat_g for r in spark.read.parquet(path).collect()}
    assert read() == {"a": 1.0, "b": 2.0, "c": 3.0}
    recipes.append_new(spark, more, path, "recipe_name", full_refresh=True)
    assert read() == {"b": 7.0, "c": 3.0}


def test_details(spark):
    data = [
        {"title": "soup", "nutrition": {"nutrients": [
            {"name": "Fat", "amount": 1.5, "unit": "g"}, {"name": "Zinc", "amount": 1, "unit": "mg"},
            {"name": "Fat", "amount": 2, "unit": "g"}]},
         "extendedIngredients": [{"original": "water"}, {"original": "salt"}],
         "analyzedInstructions": [{"steps": [{"number": 1, "step": "boil"}, {"number": 2, "step": "eat"}]}, {"steps": []}]},
        {"title": "air", "nutrition": {"nutrients": []}, "extendedIngredients": [], "analyzedInstructions": []},
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in data], "body string").select(
        F.from_json("body", schemas.RECIPE_DETAILS).alias("d")).select("d.*")
    assert {r.title: r.nutrients for r in recipes.target_nutrients(rows).collect()} == {"soup": {"Fat": "2.0 g"}, "air": {}}
    assert sorted((r.title, r.position, r.step) for r in recipes.recipe_steps(rows).collect()) == [
        ("air", None, None), ("soup", 0, "boil"), ("soup", 1, "eat")]
    assert recipes.recipe_ingredients(rows).count() == 2


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert files.read_ledger(spark, path).count() == 0
    files.append_ledger(spark.createDataFrame([("b",), ("a",)], "slug string"), path)
    files.append_ledger(spark.createDataFrame([("a",), ("c",)], "slug string"), path)
    ledger = files.read_ledger(spark, path)
    assert sorted(r.slug for r in ledger.collect()) == ["a", "b", "c"]
    files.write_sorted_ledger(ledger, str(tmp_path / "sorted"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sorted")).collect()] == ["a", "b", "c"]
