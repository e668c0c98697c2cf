"""End-to-end jobs."""

import json

from larder import jobs
from larder.sources import files

from tests.test_recommend import SCHEMA, people, recipe, wishes


def page(labels, **more):
    return {"hits": [{"recipe": {
        "label": label, "url": f"http://x/{i}", "image": "i", "yield": 2, "calories": 800.0, "cuisineType": ["indian"],
        "mealType": ["lunch/dinner"], "totalNutrients": {"SUGAR": {"label": "Sugars", "quantity": 4, "unit": "g"}}, **more,
    }} for i, label in enumerate(labels)]}


def test_recipe_refresh_is_incremental(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("json", "csv", "table", "ledger")]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "1.json").write_text(json.dumps(page(["Dal", "dal ", "Naan/Roti"])))

    def run():
        checks = {(r.test, r.column_name): r.failures for r in jobs.refresh_recipes(spark, *paths).collect()}
        table = {r.recipe_name: r for r in files.read_table(spark, paths[2]).collect()}
        return checks, table, sorted(r.slug for r in files.read_ledger(spark, paths[3]).collect())

    checks, table, ledger = run()
    assert set(checks.values()) == {0}
    assert ledger == sorted(table) == ["dal", "naan_roti"]
    assert (table["dal"].link, table["dal"].sugars_g, table["dal"].calories_per_serving_kcal) == ("http://x/0", 2.0, 400.0)
    assert files.read_recipe_partitions(spark, paths[1]).filter("recipe_name = 'dal'").count() == 8
    assert run()[1] == table
    (tmp_path / "json" / "2.json").write_text(json.dumps(page(["DAL", "Poha"])))
    checks, table, ledger = run()
    assert ledger == sorted(table) == ["dal", "naan_roti", "poha"]
    assert table["dal"].link == "http://x/0"


def test_refresh_caps_each_cuisine_and_keeps_first_hits(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("json", "csv", "table", "ledger")]
    (tmp_path / "json").mkdir()
    for name, cuisine, labels in (
        ("1", "greek", ["A", "B", "A"]), ("2", "greek", ["C", "D"]), ("3", "indian", ["B", "C", "E", "F"]), ("4", "thai", ["A", "G", "B"]),
    ):
        more = {"cuisineType": [cuisine]}
        rows = page(labels, **more)
        for i, hit in enumerate(rows["hits"]):
            hit["recipe"]["url"] = f"{cuisine}-{name}-{i}"
        (tmp_path / "json" / f"{name}.json").write_text(json.dumps(rows))
    jobs.refresh_recipes(spark, *paths, cap=2)
    table = {r.recipe_name: r.link for r in files.read_table(spark, paths[2]).collect()}
    assert table == {"a": "greek-1-0", "b": "greek-1-1", "c": "indian-3-1", "e": "indian-3-2", "g": "thai-4-1"}


def test_wishes_are_answered(spark):
    table = spark.createDataFrame([recipe("dal"), recipe("roti")], SCHEMA)
    asked = wishes(spark, [("a", ["Indian", "Thai"], ["Lunch"])] * 3)
    got = {(r.cuisine, r.meal): r.block for r in jobs.answer_wishes(spark, people(spark, [("a", "CKD")]), asked, table).collect()}
    assert got["Thai", "Lunch"] == "Nothing in the table fits Lunch with cuisine Thai"
    block = got["Indian", "Lunch"]
    assert block.startswith("### 🥗 Lunch (Indian)\n\n🍽️ **dal**  \n") and block.count("🍽️") == 2
    assert "\n🧬 Sodium Mg: 1.0" in block and block.endswith("\n")


def test_condition_context(spark):
    rows = [(f"c{i}", [1.0, float(i)], "ckd" if i < 4 else "other", f"word{i} two three") for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, condition string, text string")
    prompts = jobs.condition_context(chunks, [1.0, 0.0], "ckd", k=3, budget=7).collect()
    assert len(prompts) == 7 and {r.condition for r in prompts} == {"ckd"}
    assert all(r.prompt.endswith("Context:\nword0 two three\n\nword1 two three") for r in prompts)
