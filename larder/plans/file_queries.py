"""Files written from the given tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans.registry import query
from larder.plans.views import load, raw_recipes, with_views
from larder.sources import files, scratch

# Attribute rows of a recipe file: three per part, the last one with a field too many for every fifth part.
FILE = "'part_' || CAST(p_partkey % 40 AS STRING)"
LINES = """'Brand ' || CAST(p_partkey AS STRING) || ',' || p_brand || ',-',
  'Size ' || CAST(p_partkey AS STRING) || ',' || CAST(p_size AS STRING) || ',cm',
  'Type ' || CAST(p_partkey AS STRING) || ',' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ',-,-' ELSE ',-' END"""
LINES_SQL = f"SELECT {FILE} AS recipe_name, p_partkey, unnest([{LINES}]) AS line FROM part"
GOOD_SQL = f"""SELECT recipe_name, split_part(line, ',', 1) AS attribute, split_part(line, ',', 2) AS "value"
  FROM ({LINES_SQL}) WHERE line NOT LIKE '%,-,-'"""


def _deliver(rows, folder: str, mode: str = "overwrite") -> None:
    """Recipe files (recipe_name, line) with a header, each in a folder of its name."""
    head = rows.select("recipe_name").distinct().withColumn("line", F.lit("Nutrient,Amount per Serving,Unit")).withColumn("first", F.lit(0))
    (
        rows.withColumn("first", F.lit(1)).unionByName(head).repartition("recipe_name").sortWithinPartitions("recipe_name", "first", "line")
        # Whole lines: a separator that none of them holds.
        .select("recipe_name", "line").write.mode(mode).partitionBy("recipe_name").option("sep", "\t").option("quote", "").csv(folder)
    )


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "part").selectExpr(f"{FILE} AS recipe_name", f"explode(array({LINES})) AS line")


def _delivered(spark, sf_dir) -> str:
    folder = scratch.new_dir(spark, "recipe-files")
    _deliver(_lines(spark, sf_dir), folder)
    return folder


@query("csv_load", GOOD_SQL)
def csv_load(spark, sf_dir):
    return files.read_recipe_csvs(spark, _delivered(spark, sf_dir))


@query("csv_load_rejects", f"SELECT recipe_name, line FROM ({LINES_SQL}) WHERE line LIKE '%,-,-'")
def csv_load_rejects(spark, sf_dir):
    return files.recipe_csv_rejects(spark, _delivered(spark, sf_dir)).select("recipe_name", "line")


# Two deliveries: parts with even keys first, then the other names, and a load after each and once more.
@query("csv_load_incremental", f"""
SELECT CASE CAST(substr(recipe_name, 6) AS INT) % 2 WHEN 0 THEN 1 ELSE 2 END AS run, recipe_name, count(*) AS n
FROM ({GOOD_SQL}) GROUP BY ALL UNION ALL SELECT 3, 'nothing new', 0""")
def csv_load_incremental(spark, sf_dir):
    folder, ledger = scratch.new_dir(spark, "recipe-files"), scratch.new_dir(spark, "loaded")
    rows, runs = _lines(spark, sf_dir), []
    even = F.substr("recipe_name", F.lit(6)).cast("int") % 2 == 0
    for run, part in enumerate([rows.filter(even), rows.filter(~even), rows.limit(0)], 1):
        if run < 3:
            _deliver(part, folder, "append")
        loaded, _, new = files.load_new_csvs(spark, folder, ledger)
        counts = loaded.groupBy("recipe_name").agg(F.count(F.lit(1)).alias("n"))
        if run == 3:
            counts = counts.agg(F.when(F.count(F.lit(1)) == 0, "nothing new").alias("recipe_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        runs.append(counts.select(F.lit(run).alias("run"), "recipe_name", "n"))
        files.mark_loaded(new, ledger)
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


TALL = """SELECT recipe_name, "value", attribute, '-' AS unit FROM raw_recipes"""
NAMES = ["recipe_4", "recipe_10", "recipe_100"]


def _packed(spark, sf_dir) -> str:
    folder = scratch.new_dir(spark, "packed")
    rows = raw_recipes(spark, sf_dir).select("recipe_name", "attribute", "value", F.lit("-").alias("unit"), F.lit(0).alias("position"))
    files.write_packed_csvs(rows, folder, 5_000)
    return folder


@query("csv_packed", with_views(["raw_recipes"], f"SELECT recipe_name, attribute, unit, coalesce(\"value\", '') AS amount FROM ({TALL})"))
def csv_packed(spark, sf_dir):
    rows = files.read_packed_recipes(spark, _packed(spark, sf_dir))
    return rows.select("recipe_name", "attribute", "unit", F.coalesce("value", F.lit("")).alias("amount"))


@query("csv_packed_recipe", with_views(["raw_recipes"], f"""
SELECT recipe_name, attribute, unit, coalesce("value", '') AS amount FROM ({TALL}) WHERE recipe_name IN ({", ".join(f"'{n}'" for n in NAMES)})"""))
def csv_packed_recipe(spark, sf_dir):
    rows = files.read_packed_recipes(spark, _packed(spark, sf_dir), NAMES)
    return rows.select("recipe_name", "attribute", "unit", F.coalesce("value", F.lit("")).alias("amount"))


# Documents of one language and key, written as one text file each.
BOOKS = {"condition": "lang", "file_name": "'book' || CAST(doc_id % 8 AS STRING)"}
BOOKS_SQL = f"""SELECT {BOOKS["condition"]} AS condition, {BOOKS["file_name"]} AS file_name, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text
  FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL"""


def _books(spark, sf_dir) -> str:
    folder = scratch.new_dir(spark, "books")
    rows = load(spark, sf_dir, "documents").filter("lang IS NOT NULL AND text IS NOT NULL")
    files.write_documents(rows.selectExpr("doc_id", "text", *(f"{e} AS {a}" for a, e in BOOKS.items())), folder, "doc_id")
    return folder


@query("documents_load", f"SELECT condition, file_name, text FROM ({BOOKS_SQL})")
def documents_load(spark, sf_dir):
    return files.read_documents(spark, _books(spark, sf_dir), ".txt")


@query("files_list", f"SELECT condition, file_name, CAST(strlen(text) AS BIGINT) AS length FROM ({BOOKS_SQL})")
def files_list(spark, sf_dir):
    listed = files.list_files(spark, _books(spark, sf_dir), ".txt")
    return listed.select(
        F.regexp_extract("path", r"condition=([^/]+)/", 1).alias("condition"),
        F.regexp_extract("path", r"file_name=([^/]+)/", 1).alias("file_name"), "length")
